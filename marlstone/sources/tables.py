"""Schemas, readers and writers of the search tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What makes one search: equal rows are one group.
GROUP_KEY = ["search_query", "search_location_id", "search_infm_params_text", "search_category", "search_is_delivery_search"]
ITEM_COLUMNS = [
    "item_id", "item_title_raw", "item_description_raw", "item_infm_params_text", "item_category_id", "item_microcat_id", "item_price",
    "item_rating", "item_rating_reviews_count", "item_location_id", "item_latitude", "item_longitude", "item_is_phone_hidden", "item_is_message_forbidden",
]
DOUBLES = ("item_price", "item_latitude", "item_longitude")
TEXTS = ("search_infm_params_text", "item_title_raw", "item_description_raw", "item_infm_params_text")


def typed(df: DataFrame) -> DataFrame:
    """Prices and coordinates as double, null texts as '', for the columns that are there."""
    have = set(df.columns)
    out = {c: F.col(c).cast("double") for c in DOUBLES if c in have} | {c: F.coalesce(c, F.lit("")) for c in TEXTS if c in have}
    return df.withColumns(out) if out else df


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return typed(spark.read.parquet(path))


def read_train(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Choices; only ``columns`` are read, if given."""
    df = spark.read.parquet(path)
    return typed(df.select(*columns) if columns else df)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return typed(spark.read.parquet(path))


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_answer(df: DataFrame, path: str) -> None:
    """query_id and space-joined ids, as CSV with a header."""
    df.select("query_id", "answer").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path).fillna("", ["answer"])


def write_vectors(df: DataFrame, path: str) -> None:
    """(id, model, vec) with vec an array of float, a folder per model."""
    df.select("id", "model", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").partitionBy("model").parquet(path)


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if model is None else df.where(F.col("model") == model)


def report_rows(df: DataFrame) -> DataFrame:
    """A metrics table as one JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
