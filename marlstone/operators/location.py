"""Where items are chosen from: centres, transitions between locations, and a smoothed log prior."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALPHA = 1.0


def centroids(hist: DataFrame, items: DataFrame) -> DataFrame:
    """(loc, lat, lon): medians by item location over items and history; else by search location over history."""
    place = lambda df, loc: df.select(F.col(loc).alias("loc"), F.col("item_latitude").alias("lat"), F.col("item_longitude").alias("lon")).dropna()
    own = _medians(place(items, "item_location_id").unionByName(place(hist, "item_location_id")))
    return own.unionByName(_medians(place(hist, "search_location_id")).join(own.select("loc"), "loc", "left_anti"))


def _medians(points: DataFrame) -> DataFrame:
    """(loc, lat, lon): exact medians from running counts of the distinct values, so that no location is one buffer."""
    each = points.select("loc", F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in ("lat", "lon")])).alias("p")).select("loc", "p.*")
    counts = each.groupBy("loc", "axis", "v").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("loc", "axis").agg(F.sum("n").alias("size"))
    run = F.sum("n").over(Window.partitionBy("loc", "axis").orderBy("v"))
    middle = counts.withColumn("hi", run).join(sizes, ["loc", "axis"]).where("hi > (size - 1) div 2 and hi - n <= size div 2")
    half = lambda c: F.when(F.col("axis") == c, F.col("v"))
    return middle.groupBy("loc").agg(*[((F.min(half(c)) + F.max(half(c))) / 2).alias(c) for c in ("lat", "lon")])


def transitions(hist: DataFrame) -> DataFrame:
    """(s, l, c): choices from search location s of items in location l."""
    return hist.groupBy(F.col("search_location_id").alias("s"), F.col("item_location_id").alias("l")).agg(F.count("*").alias("c"))


def location_totals(trans: DataFrame) -> DataFrame:
    """(s, total, self_share)"""
    own = F.sum(F.when(F.col("s") == F.col("l"), F.col("c")).otherwise(0))
    return trans.groupBy("s").agg(F.sum("c").alias("total"), (own.cast("double") / F.sum("c")).alias("self_share"))


def log_prior(pairs: DataFrame, trans: DataFrame, totals: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``pairs`` (with s and l) and lp: the smoothed log share of l among the choices from s, or a guess where s is new."""
    j = pairs.join(totals.select("s", "total"), "s", "left").join(trans, ["s", "l"], "left")
    known = F.log((F.coalesce(F.col("c").cast("double"), F.lit(0.0)) + F.lit(alpha * 1e-3)) / (F.col("total").cast("double") + F.lit(alpha)))
    guess = F.when(F.col("s") == F.col("l"), F.lit(math.log(0.8))).otherwise(F.lit(math.log(1e-4)))
    return j.withColumn("lp", F.when(F.col("total").isNull(), guess).otherwise(known)).drop("total", "c")


def items_per_location(corpus: DataFrame) -> DataFrame:
    return corpus.where("in_bench").groupBy(F.col("item_location_id").alias("loc")).agg(F.count("*").alias("n_items"))
