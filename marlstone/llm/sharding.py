"""Shards of near-equal bytes by histogram sort, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, kept, quoted

#: Bits of the key that one round of probes resolves between two candidate boundaries.
PROBE_BITS = 10
#: A splitter may miss its share by so much of a shard's mean bytes.
TOLERANCE = 0.002
#: The same for splitters that leave groups of equal texts whole.
WHOLE_TOLERANCE = 0.01
#: Rows of one range of the final exchange, and ranges whose row counts are broadcast.
RANGE = 500_000
MOST_RANGES = 100_000


def _u(key: int) -> int:
    """A key as Spark holds it: 64 bits, signed."""
    return key - (1 << 64) if key >= 1 << 63 else key


def sort_key(text: Column, row_id: Column) -> Column:
    """A long whose unsigned order puts equal texts next to each other and spreads each group over its low half.

    The high half is a hash of the text, then come 20 bits of a hash of the row's id and 12 of its place in the table,
    so that a group of any size can be cut, rows that repeat id and text included. The place decides only between
    such rows, which are alike; keep the keys before they are used twice.
    """
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 32), 32)
    middle = F.shiftleft(F.shiftrightunsigned(F.xxhash64(row_id, F.lit(1)), 44), 12)
    return high.bitwiseOR(middle).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit(2)), 52))


def _step(width: int) -> int:
    """Width of the parts that an interval is probed in; one round ends exactly where the texts' hashes end."""
    step = max(0, width - PROBE_BITS)
    return 32 if step < 32 < width else step


def _below(keys: DataFrame, intervals: dict[int, int]) -> dict[int, dict[int, int]]:
    """Exact bytes in each of the (at most 2**PROBE_BITS) parts of each interval (start -> width as a power of two).

    One pass: every row finds the interval that holds it, partial sums meet per part; the driver sees only the parts.
    """
    starts = sorted(intervals)
    at = F.lit(-1)
    for i, s in enumerate(starts):
        at = F.when(F.shiftrightunsigned(F.col("key"), intervals[s]) == F.lit(_u(s) if intervals[s] == 0 else s >> intervals[s]), i).otherwise(at) if intervals[s] < 64 else F.lit(i)
    part = None
    for i, s in enumerate(starts):
        step = _step(intervals[s])
        got = F.shiftrightunsigned(F.col("key"), step).bitwiseAND((1 << (intervals[s] - step)) - 1)
        part = got if part is None else F.when(F.col("at") == i, got).otherwise(part)
    rows = keys.withColumn("at", at).where("at >= 0").groupBy("at", part.alias("part")).agg(F.sum("size").alias("b")).collect()
    out: dict[int, dict[int, int]] = {s: {} for s in starts}
    for r in rows:
        out[starts[r["at"]]][r["part"]] = r["b"]
    return out


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The (unsigned) keys at which shards 1 to shards - 1 begin.

    Each round counts exact bytes below the probes and keeps, per splitter, the one part between two probes that
    holds its target, until a probe is within the tolerance or the part is a single key. The rounds are at most
    eight, whatever the data; boundaries of the high half, which leave groups whole, come first.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    target = {j: total * j / shards for j in range(1, shards)}
    slack = tolerance * total / shards
    found: dict[int, int] = {}
    open_at = {j: (0, 64, 0) for j in target}  # start, width, bytes below start
    while open_at:
        counts = _below(keys, {s: w for s, w, _ in open_at.values()})
        nxt = {}
        for j, (start, width, below) in open_at.items():
            step = _step(width)
            at, left = below, (below, start)
            best = (abs(below - target[j]), start)
            for part in sorted(counts[start]):
                lo = start + (part << step)
                best = min(best, (abs(at - target[j]), lo))
                if at <= target[j]:
                    left = (at, lo)
                at += counts[start][part]
                best = min(best, (abs(at - target[j]), lo + (1 << step)))
            if best[0] <= (max(slack, WHOLE_TOLERANCE * total / shards) if step == 32 else slack) or step == 0:
                found[j] = best[1]
            else:
                nxt[j] = (left[1], step, left[0])
        open_at = nxt
    return [found[j] for j in sorted(found)]


def shard_of(key: Column, cuts: list[int]) -> Column:
    """How many splitters are at or below the key, in unsigned order; a cut at 2**64 is above all keys."""
    flip = F.lit(-(1 << 63))
    flipped = key.bitwiseXOR(flip)
    return sum((F.when(flipped >= F.lit(_u(c ^ (1 << 63))), 1).otherwise(0) for c in cuts if c < 1 << 64), F.lit(0))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; the bytes of the shards are near equal.

    size: UTF-8 bytes of the text plus 1, a null text counting as empty. Equal texts lie next to each other, so a
    group of copies shares a shard unless a boundary must cut it to keep the bytes equal; rows that repeat id and text
    can be cut apart too. slot numbers the rows of a shard from 0 without gaps, in the order of the keys, so that the
    table comes out sorted. A null id is a value like any other; other columns are not read; an empty table has no
    rows. The keys are written once (four longs a row), histograms read only them, and the rows are exchanged once, by
    ranges of the key inside the shards; a row's place in its range, and the rows of the ranges before, make its slot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = checkpointed(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), sort_key(text, F.col(id_col)).alias("key")))
    cuts = splitters(keys, shards, tolerance)
    order = ["shard", "at", "doc_id"]
    placed = keys.select("doc_id", "size", "text_crc32", shard_of(F.col("key"), cuts).cast("int").alias("shard"), F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("at"))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // RANGE))
    ranged = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("at")
    # The id that Spark counts up holds the partition above 33 bits and the place of the row in it below.
    ranged = checkpointed(ranged.withColumn("place", F.monotonically_increasing_id())).withColumn("range", F.shiftright("place", 33))
    sizes = ranged.groupBy("shard", "range").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("range")) - F.col("rows")
    firsts = sizes.select("shard", "range", (before - F.col("first")).alias("shift"))
    firsts = F.broadcast(firsts) if ranges <= MOST_RANGES else firsts
    return ranged.join(firsts, ["shard", "range"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> None:
    """Write whole rows as one folder ``name=k`` per shard, cut like :func:`shard_by_bytes`."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the documents have a column {name}: give the folders another name")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    row = F.struct(*[quoted(c) for c in docs.columns])
    keyed = kept(docs.select(row.alias("row"), sort_key(text, F.col(quoted(id_col))).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size")), "keyed")
    cuts = splitters(keyed.select("key", "size"), shards)
    dealt = keyed.withColumn(name, shard_of(F.col("key"), cuts).cast("int")).repartition(name, F.pmod("key", F.lit(64)))
    dealt.select("row.*", name).write.partitionBy(name).parquet(path)
