"""Training pairs of query and item, hard negatives, and batches without a repeated query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbering import numbered
from ..functions.rng import order_key
from .dense import block_topk

SKIP, TOP, CAP = 3, 30, 30
SEED = 42
#: What the steps on pairs read of a choice.
PAIR_COLUMNS = ("row_key", "search_query", "search_infm_params_text", "item_id", "row_id", "item_location_id")


def _first(df: DataFrame, keys: list[str], order) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def distinct_pairs(hist: DataFrame) -> DataFrame:
    """The first choice by row_key of each (query, filter text, item)."""
    return _first(hist, ["search_query", "search_infm_params_text", "item_id"], ["row_key"])


def cap_pairs(pairs: DataFrame, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """At most ``cap`` random pairs per query text."""
    w = Window.partitionBy("search_query").orderBy(order_key(seed, "cap", "row_key"), "row_key")
    return pairs.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cap).drop("__rn")


def pair_items(pairs: DataFrame) -> DataFrame:
    return _first(pairs, ["item_id"], ["row_key"])


def chosen_by_text(pairs: DataFrame) -> DataFrame:
    return pairs.select("search_query", "row_id").distinct()


def hard_negatives(pairs: DataFrame, texts: DataFrame, items: DataFrame, chosen: DataFrame, skip: int = SKIP, top: int = TOP, spare: int = 5, seed: int = SEED) -> DataFrame:
    """(row_key, neg): per pair one item near the query in the chosen item's location that its text never chose.

    pairs: row_key, search_query, loc, capped per text; texts: search_query, vec; items: row_id, vec, loc. Of the top +
    spare nearest, those chosen for the text go; one of the ranks from ``skip`` up to ``top`` of the rest is drawn. Pairs
    without one have no row. The nearest are searched once per text and location, whatever the number of its pairs, and
    a pair draws inside its row from the list that is left.
    """
    asked = pairs.select("search_query", "loc").distinct().join(texts, "search_query")
    asked = asked.select(F.sha2(F.concat_ws("|", F.col("loc").cast("string"), "search_query"), 256).alias("qid"), "search_query", "loc", "vec")
    near = block_topk(asked.select("qid", "vec", "loc"), items.select("row_id", "vec", "loc"), top + spare, place="same")
    lists = near.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "row_id"))), lambda s: s["row_id"]).alias("near"))
    own = chosen.groupBy("search_query").agg(F.collect_set("row_id").alias("own"))
    left = asked.select("qid", "search_query", "loc").join(lists, "qid").join(own, "search_query")
    rest = F.filter("near", lambda i: ~F.array_contains("own", i))
    left = left.select("search_query", "loc", F.slice(rest, skip + 1, top - skip).alias("rest")).where(F.size("rest") > 0)
    draw = F.array_min(F.transform("rest", lambda i: F.struct(order_key(seed, "neg", F.col("row_key"), i).alias("by"), i.alias("neg"))))
    return pairs.join(left, ["search_query", "loc"]).select("row_key", draw["neg"].alias("neg"))


def fill_negatives(pairs: DataFrame, found: DataFrame, seed: int = SEED) -> DataFrame:
    """(row_key, neg, hard): a pair without a hard negative gets the item of another place in a random permutation."""
    given = numbered(pairs.select("row_key"), ["row_key"], "n")
    other = numbered(pairs.select("row_id", "row_key"), [order_key(seed, "fill", "row_key"), "row_key"], "n").select("n", F.col("row_id").alias("spare"))
    j = given.join(other, "n").join(found, "row_key", "left")
    return j.select("row_key", F.coalesce("neg", "spare").alias("neg"), F.col("neg").isNotNull().alias("hard"))


def unique_batches(pairs: DataFrame, batch: int, seed: int = SEED) -> DataFrame:
    """(row_key, search_query, layer, batch): full batches in which no query text repeats.

    A text's k-th pair goes to layer k; a layer is cut into batches in random order and its short tail is dropped.
    """
    w = Window.partitionBy("search_query").orderBy(order_key(seed, "layer", "row_key"), "row_key")
    layered = pairs.select("row_key", "search_query").withColumn("layer", F.row_number().over(w).cast("long"))
    n = numbered(layered, ["layer", order_key(seed, "batch", "row_key"), "row_key"], "n")
    sizes = n.groupBy("layer").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    b = n.join(sizes, "layer").withColumn("batch", F.floor((F.col("n") - F.col("first")) / batch))
    return b.where((F.col("batch") + 1) * batch <= F.col("size")).select("row_key", "search_query", "layer", "batch")
