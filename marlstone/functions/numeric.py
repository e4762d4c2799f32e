"""Numeric columns of items and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
FAR_KM = 5000.0


def item_features() -> dict[str, Column]:
    """Features of an item by name; every null has a value of its own."""
    zero = F.lit(0.0)
    number = lambda c: F.coalesce(F.col(c).cast("double"), zero)
    return {
        "i_rating": F.coalesce(F.col("item_rating").cast("double"), F.lit(-1.0)),
        "i_reviews": F.log1p(number("item_rating_reviews_count")),
        "i_price": F.log1p(F.greatest(zero, F.least(number("item_price"), F.lit(1e9)))),
        "i_phone_hidden": F.col("item_is_phone_hidden").cast("double"),
        "i_msg_forbidden": F.col("item_is_message_forbidden").cast("double"),
        "i_dlen": F.log1p(F.char_length(F.coalesce("item_description_raw", F.lit(""))).cast("double")),
        "i_tlen": F.char_length(F.coalesce("item_title_raw", F.lit(""))).cast("double"),
    }


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(a, F.lit(1.0)))))


def distance_feature(km: Column) -> Column:
    return F.log1p(F.coalesce(F.nanvl(km, F.lit(FAR_KM)), F.lit(FAR_KM)))


def same_location(a: Column, b: Column) -> Column:
    return F.coalesce((a == b).cast("double"), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, without leaving the JVM; for a few pairs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, digits: int) -> Column:
    """``x`` at so many digits as DuckDB rounds: a small negative number becomes -0.0, where Spark's round gives 0.0."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * (F.round(F.abs(x) * scale, 0) / scale)
