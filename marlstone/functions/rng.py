"""Random choice from hashes of keys: the same rows give the same draws, however they are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, tag: str, *keys: Column | str) -> Column:
    """A hash to order rows by at random; null keys are skipped."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[c.cast("string") for c in cols]))


def uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    """A number in [0, 1): the first 48 bits of the hash."""
    return F.conv(F.substring(order_key(seed, tag, *keys), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def normal(seed: int, tag: str, *keys: Column | str) -> Column:
    """A standard normal number, by Box and Muller from two uniform ones."""
    u = F.lit(1.0) - uniform(seed, tag + "|r", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * uniform(seed, tag + "|a", *keys))
