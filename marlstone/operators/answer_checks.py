"""Checks of an answer table; each returns one row (check, n_bad)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID_LENGTH = 16
ITEM_ID = "^[0-9a-f]{16}$"
MOST = 50


def _row(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")


def _ids(ans: DataFrame) -> DataFrame:
    return ans.where("answer <> ''").select("query_id", F.explode(F.split("answer", " ")).alias("item_id"))


def header(ans: DataFrame) -> DataFrame:
    """All rows are bad under a header other than ``query_id,answer``."""
    return _row("header", ans.where(F.lit(ans.columns != ["query_id", "answer"])))


def query_ids(ans: DataFrame) -> DataFrame:
    """Query ids that repeat, and rows whose id has another length."""
    return _row("repeated_query", ans.groupBy("query_id").count().where("count > 1")).unionByName(_row("query_id_length", ans.where(F.length("query_id") != ID_LENGTH)))


def query_set(ans: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries without a row, and rows without a query; queries: query_id."""
    a, q = ans.select("query_id").distinct(), queries.select("query_id").distinct()
    return _row("missing_query", q.join(a, "query_id", "left_anti")).unionByName(_row("unknown_query", a.join(q, "query_id", "left_anti")))


def row_size(ans: DataFrame, most: int = MOST) -> DataFrame:
    return _row("too_many_items", ans.where(F.size(F.split("answer", " ")) > most))


def repeated_items(ans: DataFrame) -> DataFrame:
    ids = F.split("answer", " ")
    return _row("repeated_item", ans.where(F.size(F.array_distinct(ids)) < F.size(ids)))


def item_format(ans: DataFrame) -> DataFrame:
    return _row("item_id_format", _ids(ans).where(~F.col("item_id").rlike(ITEM_ID)))


def known_items(ans: DataFrame, items: DataFrame) -> DataFrame:
    return _row("unknown_item", _ids(ans).join(items.select("item_id"), "item_id", "left_anti"))


def sizes(ans: DataFrame) -> DataFrame:
    n = F.when(F.col("answer") == "", 0).otherwise(F.size(F.split("answer", " ")))
    return ans.agg(F.count("*").alias("rows"), F.min(n).cast("long").alias("min_items"), F.max(n).cast("long").alias("max_items"))


def all_checks(ans: DataFrame, queries: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    parts = [header(ans), query_ids(ans), query_set(ans, queries), row_size(ans, most), repeated_items(ans), item_format(ans), known_items(ans, items)]
    return reduce(DataFrame.unionByName, parts)
