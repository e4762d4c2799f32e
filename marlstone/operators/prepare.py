"""Folds without leakage: sampled search groups, history without them, and the corpus that each fold sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import order_key
from ..sources.tables import GROUP_KEY

SEED = 42


def group_id() -> Column:
    """A hash of the group key; a null is a value of its own."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in GROUP_KEY]))


def search_groups(train: DataFrame) -> DataFrame:
    return train.withColumn("gid", group_id()).groupBy("gid", *GROUP_KEY).agg(F.count("*").alias("n"))


def sample_texts(groups: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``n`` distinct query texts of groups, or of choices, at random; the rows that are ordered are the best n of each task."""
    return groups.select("search_query").distinct().orderBy(order_key(seed, "text", "search_query"), "search_query").limit(n)


def one_per_text(groups: DataFrame, texts: DataFrame, seed: int = SEED) -> DataFrame:
    w = Window.partitionBy("search_query").orderBy(order_key(seed, "group", "gid"), "gid")
    return groups.join(texts, "search_query", "left_semi").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def assign_folds(chosen: DataFrame, n_folds: int, seed: int = SEED) -> DataFrame:
    """Folds of equal size; the rows are the sampled groups, one per text, whose number is a parameter."""
    w = Window.orderBy(order_key(seed, "fold", "gid"), "gid")
    return chosen.withColumn("fold", ((F.row_number().over(w) - 1) % n_folds).cast("int"))


def fold_qid(folded: DataFrame) -> DataFrame:
    return folded.withColumn("qid", F.format_string("v%d_%s", "fold", F.substring("gid", 1, 13)))


def mark_held(train: DataFrame, folded: DataFrame) -> DataFrame:
    """All choices with gid, and the qid and fold of the sampled groups, null for the others: one table holds both parts."""
    return train.withColumn("gid", group_id()).join(folded.select("gid", "qid", "fold"), "gid", "left")


def held_part(marked: DataFrame) -> DataFrame:
    return marked.where("qid is not null")


def history_part(marked: DataFrame) -> DataFrame:
    return marked.where("qid is null").drop("gid", "qid", "fold")


def split_history(train: DataFrame, folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, history): the choices of the sampled groups with their qid and fold, and all others."""
    marked = mark_held(train, folded)
    return held_part(marked), history_part(marked)


def validation_queries(held: DataFrame) -> DataFrame:
    """One row per sampled group; rel: its distinct chosen items in order of id."""
    return held.groupBy("qid", "fold", *GROUP_KEY).agg(F.sort_array(F.collect_set("item_id")).alias("rel"))


def all_queries(validation: DataFrame, bench: DataFrame) -> DataFrame:
    """Validation queries and the benchmark's, which have fold -1 and no rel."""
    b = bench.select(F.col("query_id").alias("qid"), F.lit(-1).alias("fold"), *GROUP_KEY, F.lit(None).cast("array<string>").alias("rel"))
    return validation.select(b.columns).unionByName(b)


def extra_items(held: DataFrame, items: DataFrame) -> DataFrame:
    """Chosen items that the benchmark lacks: the first row of each by row_key, with the folds that chose it."""
    new = held.join(items.select("item_id"), "item_id", "left_anti")
    folds = new.groupBy("item_id").agg(F.sort_array(F.collect_set(F.col("fold").cast("long"))).alias("folds"))
    w = Window.partitionBy("item_id").orderBy("row_key")
    return new.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*items.columns).join(folds, "item_id")


def build_corpus(items: DataFrame, extra: DataFrame) -> DataFrame:
    bench = items.withColumn("folds", F.lit(None).cast("array<bigint>"))
    return bench.unionByName(extra.select(bench.columns)).withColumn("in_bench", F.col("folds").isNull())


def visible(fold: Column, in_bench: Column, folds: Column) -> Column:
    """A benchmark item, or one that the query's fold added."""
    return in_bench | F.coalesce(F.array_contains(folds, fold.cast("long")), F.lit(False))


def seen_stats(validation: DataFrame, hist: DataFrame) -> DataFrame:
    """Share of queries whose text, and whose text in the same location, occurs in history."""
    t = hist.select("search_query", F.lit(1.0).alias("t")).distinct()
    tl = hist.select("search_query", "search_location_id", F.lit(1.0).alias("tl")).distinct()
    j = validation.join(t, "search_query", "left").join(tl, ["search_query", "search_location_id"], "left")
    return j.agg(F.avg(F.coalesce("t", F.lit(0.0))).alias("seen_text"), F.avg(F.coalesce("tl", F.lit(0.0))).alias("seen_text_loc"))
