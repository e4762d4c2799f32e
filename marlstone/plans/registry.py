"""Queries by name, with the SQL that each equals, and the views over the driver's tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.stages import measured_broadcasts

#: The joins of train_v as SQL has them, and in the order that moves least: orders meet their customers and parts their
#: items before the lines meet either.
JOINED = """from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
             join part on l_partkey = p_partkey join items_v i on i.row_id = p_partkey"""
GROUPED = """from lineitem join (orders join customer on o_custkey = c_custkey) on l_orderkey = o_orderkey
             join (part join items_v i on i.row_id = p_partkey) on l_partkey = p_partkey"""
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Stand-ins for the search tables over the driver's tables. The same text runs on Spark and on DuckDB.
VIEWS: dict[str, str] = {
    "items_v": """
        select p_partkey as row_id, substr(md5(concat('item|', cast(p_partkey as string))), 1, 16) as item_id, p_name as item_title_raw,
               concat(p_name, ', ', lower(p_type), ' size ', cast(p_size as string)) as item_description_raw,
               concat('Вид услуги ', p_brand, ' Тип услуги ', p_type) as item_infm_params_text,
               case when p_type = 'ECONOMY' then 27 else 114 end as item_category_id, cast(replace(p_brand, 'Brand#', '') as int) as item_microcat_id,
               p_retailprice as item_price, case when p_size % 5 = 0 then null else cast(p_size % 6 as double) end as item_rating,
               case when p_size % 5 = 0 then null else p_size end as item_rating_reviews_count, cast(p_partkey % 25 as int) as item_location_id,
               case when p_partkey % 50 = 7 then null else cast(40 + p_partkey % 25 as double) + cast(p_partkey % 7 as double) / 100 end as item_latitude,
               case when p_partkey % 50 = 7 then null else cast(20 + 2 * (p_partkey % 25) as double) + cast(p_partkey % 11 as double) / 100 end as item_longitude,
               p_size % 2 = 0 as item_is_phone_hidden, p_size % 7 = 0 as item_is_message_forbidden
        from part""",
    "bench_items_v": "select * from items_v where row_id % 10 <> 0",
    "train_v": """
        select md5(concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string),
                   cast(cast(l_quantity as bigint) as string), cast(cast(round(l_extendedprice * 100) as bigint) as string))) as row_key,
               concat(p_name, ' ', lower(p_type)) as search_query, c_nationkey as search_location_id,
               case when o_orderstatus = 'P' then concat('Вид услуги ', p_brand) else '' end as search_infm_params_text,
               case when substr(o_orderpriority, 1, 1) = '5' then 0 else 114 end as search_category, o_orderstatus = 'F' as search_is_delivery_search, i.*
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
             join part on l_partkey = p_partkey join items_v i on i.row_id = p_partkey""",
    "bench_queries_v": """
        select substr(md5(concat('query|', cast(p_partkey as string))), 1, 16) as query_id,
               case when p_partkey % 3 = 0 then concat(p_name, ' ', lower(p_type)) else concat(lower(p_brand), ' ', p_name, ' ', cast(p_size as string)) end as search_query,
               cast(p_partkey % 27 as int) as search_location_id, case when p_partkey % 4 = 0 then concat('Вид услуги ', p_brand) else '' end as search_infm_params_text,
               case when p_partkey % 11 = 0 then 0 else 114 end as search_category, p_partkey % 5 = 0 as search_is_delivery_search
        from part where p_partkey % 8 = 3""",
    "doc_items_v": """
        select doc_id as row_id, array_to_string(list_slice(string_split(trim(regexp_replace(replace(lower(coalesce(text, '')), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g')), ' '), 1, 8), ' ') as title,
               concat(lang, ' ', source) as params, text as description from documents""",
    "doc_queries_v": "select item_id as qid, text as query, case when item_id % 2 = 0 then concat('вид en src', cast(item_id % 5 as varchar)) else '' end as filters from benchmark",
    "vec_items_v": "select vec_id as row_id, embedding as vec, cast(label as int) as loc from embeddings where vec_id % 10 <> 0",
    "vec_queries_v": "select vec_id as qid, embedding as vec, cast(label as int) as loc from embeddings where vec_id % 10 = 0",
}
NEEDS = {"bench_items_v": ["items_v"], "train_v": ["items_v"]}


def views(names: list[str], done: set[str] | None = None) -> str:
    """``with`` clauses of the views named and of those that they need."""
    done = set() if done is None else done
    out = []
    for n in names:
        for v in [*NEEDS.get(n, ()), n]:
            if v not in done:
                done.add(v)
                out.append(f"{v} as ({VIEWS[v]})")
    return ",\n".join(out)


def query(name: str, sql: str | None = None, using: tuple[str, ...] | list[str] = ()) -> Callable[[Query], Query]:
    """Register a query and its SQL, which may start with further ``with`` clauses after the views it uses."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            head = views(list(using))
            body = sql.strip()
            if body.startswith("with "):
                ORACLES[name] = f"with {head}{', ' if head else ''}{body[5:]}"
            else:
                ORACLES[name] = f"with {head} {body}" if head else body
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name == "documents" else df


def reads(spark: SparkSession, sf: str, name: str) -> int:
    """The number of tasks that read a table and work on its rows; it grows with the table."""
    return max(spark.read.parquet(f"{sf}/{name}.parquet").rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores by a hash of the row if it is read in fewer splits than that: a row group is one task.

    Work on texts costs far more than moving them once. A table that is read in as many splits as there are cores,
    or more, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *df.columns) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame."""
    if name == "doc_items_v":
        from pyspark.sql import functions as F

        from ..functions.text import normalize

        return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.array_join(F.slice(F.split(normalize("text"), " "), 1, 8), " ").alias("title"), F.concat("lang", F.lit(" "), "source").alias("params"), F.col("text").alias("description"))
    if name in ("items_v", "bench_items_v", "bench_queries_v", "train_v"):
        measured_broadcasts(spark)
    for t in ("part", "lineitem", "orders", "customer", "benchmark", "embeddings"):
        if f" {t}" in VIEWS[name] + "".join(VIEWS[v] for v in NEEDS.get(name, ())):
            table(spark, sf, t).createOrReplaceTempView(t)
    head = views(NEEDS.get(name, []))
    return spark.sql((f"with {head} " if head else "") + VIEWS[name].replace(JOINED, GROUPED).replace("as varchar)", "as string)"))
