"""URL rules by a sort-merge range join over reversed-host keys, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, quoted, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``: a host and its subdomains are the strings with one prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _edges(rules: DataFrame) -> DataFrame:
    """(key, stack): from each edge of a rule's interval on, the rules that are active, the longest first.

    The prefix ``p.`` is the interval from ``p.`` up to, without, ``p/`` (the next character), so that intervals
    are nested or apart. Only rules meet here, by equality of an ancestor's key: each rule names its ancestors.
    """
    r = rules.where("host is not null and host <> ''").select(reversed_host(F.translate("host", UPPER, LOWER)).alias("start"), F.coalesce("path", F.lit("")).alias("path"), F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), "verdict")
    at_host = r.groupBy("start").agg(F.collect_set(F.struct((F.length("start") + F.length("path")).alias("n"), F.length("start").alias("h"), "path", "rule", "verdict")).alias("own"))
    labels = F.split(F.col("start"), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.concat(F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit(".")))
    above = at_host.select("start", F.explode(prefixes).alias("ancestor"))
    own = at_host.select(F.col("start").alias("ancestor"), "own")
    stacks = above.join(own, "ancestor").groupBy("start").agg(F.sort_array(F.flatten(F.collect_list("own")), asc=False).alias("stack"), F.max(F.when(F.col("ancestor") != F.col("start"), F.col("ancestor"))).alias("outer"))
    ends = stacks.select(F.concat(F.expr("substring(start, 1, length(start) - 1)"), F.lit("/")).alias("key"), F.col("outer").alias("start")).join(stacks.select("start", F.col("stack").alias("outer_stack")), "start", "left")
    none = F.expr("cast(array() as array<struct<n:int,h:int,path:string,rule:string,verdict:string>>)")
    return stacks.select(F.col("start").alias("key"), "stack", F.lit(1).alias("kind")).unionByName(ends.select("key", F.coalesce("outer_stack", none).alias("stack"), F.lit(0).alias("kind")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", partitions: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of ``pages`` with those names are replaced.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's; the
    longest wins, then that with the longer host, then a block. Pages that no rule fits get a null rule and
    ``default``. Rules without a host fit nothing; without a path, every path.

    Pages and the edges of the rules' intervals are range-partitioned together by reversed host and swept in order:
    the last edge at or before a page holds the stack of active rules. An edge is carried into the following
    partitions through a table with one row per partition. Urls that repeat are spread by a hash of the row, so that a
    host or a url of any size is cut into many partitions. Pass only the columns that are needed: rows are written to
    the shared folder once.
    """
    base = without(pages, ["host", "path", "rule", "verdict"])
    p = base.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    row = F.struct(*[quoted(c) for c in p.columns])
    edges = _edges(rules)
    stream = edges.select("key", "kind", F.lit(0).cast("long").alias("salt"), F.lit(None).cast(p.select(row.alias("r")).schema[0].dataType).alias("row"), "stack").unionByName(
        p.select(reversed_host(F.col("host")).alias("key"), F.lit(2).alias("kind"), F.xxhash64(url_col, F.monotonically_increasing_id()).alias("salt"), row.alias("row"), F.lit(None).cast(edges.schema["stack"].dataType).alias("stack"))
    )
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: both the carried table and the sweep must see the same partitions.
    ranged = checkpointed(stream.repartitionByRange(n, "key", "kind", "salt").withColumn("pid", F.spark_partition_id()))
    newest = ranged.where("kind < 2").groupBy("pid").agg(F.max_by("stack", F.struct("key", "kind")).alias("newest"))
    pids = pages.sparkSession.range(n).select(F.col("id").cast("int").alias("pid"))
    carried = pids.join(newest, "pid", "left").select("pid", F.last("newest", True).over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    swept = ranged.withColumn("here", F.last("stack", True).over(Window.partitionBy("pid").orderBy("key", "kind", "salt").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 2")
    active = swept.join(F.broadcast(carried), "pid", "left").select("row.*", F.coalesce("here", "carried").alias("__stack"))
    hit = F.get(F.filter("__stack", lambda r: F.col("path").startswith(r["path"])), 0)
    return active.select(*[quoted(c) for c in p.columns], hit["rule"].alias("rule"), F.coalesce(hit["verdict"], F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of (host, path, verdict)."""
    rows = [F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(r, ("host", "path", "verdict"))]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
