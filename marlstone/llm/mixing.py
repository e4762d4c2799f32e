"""Mixing sources to target weights: multinomial shard counts over fixed-length blocks in pseudorandom order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import append_columns, kept, place_of, quoted, release, row_hash, text_slices

#: Words of a block, and blocks of an output shard.
BLOCK = 64
SHARD = 8192
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
SEED = 6
#: Documents that are laid end to end together, and places that a running total takes together.
LAY = 1500
WIDTH = 4096
#: Full output shards that one task unfolds into slots.
UNFOLD = 32


def word_sizes(docs: DataFrame, text_col: str = "text", out: str = "size") -> DataFrame:
    """``docs`` with the number of words of each whole text (null: 0)."""
    return append_columns(docs, text_col, [T.StructField(out, T.LongType())], lambda: lambda texts: [[len(t.split()) for t in texts]])


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with sid, weight and target.

    Sources by code point, null last, have the weights in turn, and share ``share`` of all sizes by weight; no target
    is above ``most`` times its source's size, the excess going to the others by weight. In order of size per weight,
    a source stops at its limit when the level that is left for it and all later ones would lift it over; so the
    repeated resharing has a closed form in running sums. The table has one row per source, already summed.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("limit", float(most) * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    capped = F.col("weight") * F.col("level") >= F.col("limit")
    s = s.withColumn("capped", capped).withColumn("rest", F.min(F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("weight"), "sid", "level"))).over(everything)["level"])
    return s.select("source", "source_size", "sid", "weight", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * F.col("rest")).alias("target"))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of range(n) per key, applied to each index.

    A Feistel network over the smallest even number of bits that holds n; places at n or above are sent through again
    until they fall below (cycle walking), which keeps it one to one.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1).astype(np.int64) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, live = index.astype(np.uint64), np.arange(len(index))
    key, n = key.astype(np.uint64), n.astype(np.uint64)
    while len(live):
        left, right = out[live] >> half[live], out[live] & mask[live]
        for r in range(rounds):
            left, right = right, left ^ (_scramble(right + key[live] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r * 0xD1B54A32D192ED03 % (1 << 64))) & mask[live])
        out[live] = left << half[live] | right
        live = live[out[live] >= n[live]]
    return out.astype(np.int64)


def _scramble(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_total(df: DataFrame, by: list[str], place: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``by`` with a smaller ``place`` (whole numbers, distinct).

    In two steps: places are taken in runs of ``width``; the sums of the runs, and the rows inside a run, are each
    summed up in order, so that no task holds all places.
    """
    run = F.floor(F.col(place) / width).alias("run")
    sums = df.groupBy(*by, run).agg(F.sum(value).alias("in_run"))
    before = F.sum("in_run").over(Window.partitionBy(*by).orderBy("run")) - F.col("in_run")
    inside = F.sum(value).over(Window.partitionBy(*by, "run").orderBy(place)) - F.col(value)
    return df.withColumn("run", F.floor(F.col(place) / width)).withColumn("inside", inside).join(sums.withColumn("before", before).drop("in_run"), [*by, "run"]).withColumn(out, F.col("before") + F.col("inside")).drop("run", "inside", "before")


def slots(targets: DataFrame, block: int = BLOCK, shard: int = SHARD, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(shard, sid, k, epoch, block): the output, one row per slot, and the block of its source that fills it.

    A source's blocks are needed target / (its mean block) times, ``most`` times each at most. Each output shard has
    ``shard`` slots, the last one what is left, and draws its counts per source from one multinomial distribution with
    a seed of its own. Running sums over the shards give each draw its place in the source's sequence. Draws beyond
    what a source needs are void; over all shards there are as many as other sources lack, and these take the void
    slots, in order, so that every source meets its target to half a block. Place k of a source is block
    permute(k mod blocks) of pass k div blocks. The table of sources, a row each, is the only one that reaches the driver.
    """
    need = F.least(F.round(F.col("target") * F.ceil(F.col("source_size") / block) / F.col("source_size")).cast("long"), F.floor(float(most) * F.ceil(F.col("source_size") / block)).cast("long"))
    t = targets.where("source_size > 0").select("sid", F.ceil(F.col("source_size") / block).alias("blocks"), need.alias("need")).where("need > 0")
    mix = t.select("sid", "need").toArrow().sort_by("sid")
    sids, needs = mix.column("sid").to_numpy(), mix.column("need").to_numpy()
    total = int(needs.sum())
    spark = targets.sparkSession

    def draw(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            each = [np.random.default_rng([seed, int(i)]).multinomial(min(shard, total - int(i) * shard), needs / total) for i in ids]
            drawn = np.array(each, np.int64).reshape(len(ids), len(sids))
            row, col = np.nonzero(drawn)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(sids[col].astype(np.int32)), pa.array(drawn[row, col])], names=["shard", "sid", "drawn"])

    shards = spark.range(0, -(-total // shard), 1, max(1, total // (UNFOLD * shard)))
    drawn = kept(running_total(shards.mapInArrow(draw, "shard long, sid int, drawn long"), ["sid"], "shard", "drawn", "first").join(t, "sid"), "drawn")
    good = F.greatest(F.lit(0), F.least("drawn", F.col("need") - F.col("first"))).cast("long")
    runs = drawn.select("shard", "sid", "first", good.alias("n"))
    void = drawn.select("shard", "sid", (F.col("drawn") - good).alias("void")).where("void > 0")
    # Lacks of the sources, end to end: place v of the void slots belongs to the source whose stretch holds v.
    got = drawn.groupBy("sid").agg(F.sum("drawn").alias("got")).toArrow()
    had = dict(zip(got.column("sid").to_pylist(), got.column("got").to_pylist()))
    have = np.array([had.get(s, 0) for s in sids.tolist()], np.int64)
    lack = np.maximum(needs - have, 0)
    ends = np.cumsum(lack)

    def refill(batches):
        for b in batches:
            out = []
            for where, lo, n in zip(b.column("shard").to_pylist(), b.column("at").to_pylist(), b.column("void").to_pylist()):
                hi = lo + n
                while lo < hi:
                    s = int(np.searchsorted(ends, lo, "right"))
                    n = min(hi, int(ends[s])) - lo
                    out.append((where, sids[s], have[s] + lo - (ends[s] - lack[s]), n))
                    lo += n
            where, sid, first, n = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(sid, pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["shard", "sid", "first", "n"])

    # All void slots in the order of shard and source; the shards' sums are one more table of a row per shard.
    by_shard = running_total(void.groupBy("shard").agg(F.sum("void").alias("sum")).withColumn("all", F.lit(0)), ["all"], "shard", "sum", "above").select("shard", "above")
    inside = F.sum("void").over(Window.partitionBy("shard").orderBy("sid")) - F.col("void")
    placed = void.withColumn("inside", inside).join(by_shard, "shard").select("shard", (F.col("above") + F.col("inside")).alias("at"), "void")
    runs = runs.unionByName(placed.mapInArrow(refill, "shard long, sid int, first long, n long")).where("n > 0").join(t.select("sid", "blocks"), "sid")
    # The rows before unfolding are few and would be gathered in one task by their size: the number of tasks follows
    # the number of slots instead.
    each = runs.repartition(max(1, total // (UNFOLD * shard)), "shard", "sid", "first").select("shard", "sid", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))

    @F.pandas_udf(T.LongType())
    def place(index, n, key):
        import pandas as pd

        return pd.Series(permute(index.to_numpy(), n.to_numpy(), key.to_numpy()))

    each = each.withColumn("epoch", F.floor(F.col("k") / F.col("blocks")).cast("int"))
    return each.select("shard", "sid", "k", "epoch", place(F.pmod("k", "blocks"), "blocks", (F.col("epoch") + F.col("sid") * 2 + seed * 1000).cast("long")).alias("block"))


def lay(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, row, copy, size, sid) with the start of each document when a source's words lie end to end.

    Order within a source is by a hash bucket of some LAY documents, then by id: running totals over the buckets, and
    sums inside each bucket, give the starts without an ordering of all.
    """
    buckets = max(1, sized.count() // LAY)
    b = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row", "copy"), F.lit(buckets)))
    totals = running_total(b.groupBy("sid", "bucket").agg(F.sum("size").alias("t")), ["sid"], "bucket", "t", "base").drop("t")
    inside = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("doc_id", "row", "copy")) - F.col("size")
    return b.withColumn("inside", inside).join(totals, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("bucket", "inside", "base")


def block_pieces(laid: DataFrame, block: int = BLOCK) -> DataFrame:
    """``laid`` with (block, at, words): the part of each document that lies in each block of its source."""
    p = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return p.withColumn("at", lo - F.col("start")).withColumn("words", hi - lo)


def _prepare(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, copies, size, sid, source_size, target) of all different rows, and the sources."""
    d = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.col(quoted(source_col)).cast("string").alias("source"), F.col(quoted(text_col)).alias("text"))
    sized = kept(word_sizes(d).select("doc_id", "row", "source", "size"), "sized")
    targets = kept(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    rows = sized.groupBy("doc_id", "row", "source", "size").agg(F.count("*").alias("copies"))
    known = rows.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return kept(known.select("doc_id", "row", "copies", "size", "sid", "source_size", F.col("target").cast("double").alias("target")), "rows"), targets


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each copy, numbered from 1."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


KEY = ["doc_id", "row", "copy"]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document; ``taken`` counts the words that the mix takes of it.

    Blocks of ``block`` words run across documents; a slot of the output takes a whole block, at most ``most`` times,
    so no document exceeds that many times its size. Everything is drawn from seeds, ids and rows: reruns agree. Null and empty texts have
    size 0 and nothing taken; a null source is a source; repeated rows are documents of their own, null ids and equal
    ids with other rows too; columns beside the three only tell rows of one id apart; an empty table gives no rows.
    """
    rows, targets = _prepare(docs.select(*[quoted(c) for c in (id_col, text_col, source_col)]), id_col, text_col, source_col, weights, share, most)
    laid = lay(_copies(rows))
    taken = slots(targets, block, shard, most, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    got = block_pieces(laid, block).join(taken.hint("merge"), ["sid", "block"]).groupBy(*KEY).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    on = F.col("s.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("s.row") == F.col("g.row")) & (F.col("s.copy") == F.col("g.copy"))
    out = _copies(rows).alias("s").join(got.alias("g"), on, "left")
    return out.select("s.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row per document and pass that takes words of it.

    The text is the words taken, in order: whole where a pass takes the whole document, else the passages of the
    blocks taken, joined by line breaks. ``chars_col``, where there is one, gets the new length. Rows are treated as
    :func:`mix` says; those without words give none.
    """
    rows, targets = _prepare(docs, id_col, text_col, source_col, weights, share, most)
    laid = lay(_copies(rows))
    # The slots unfold from a small table, so that Spark takes them for small; they grow with the corpus.
    chosen = slots(targets, block, shard, most, seed).select("sid", "block", "epoch")
    spans = block_pieces(laid, block).join(chosen.hint("merge"), ["sid", "block"]).groupBy(*KEY, "epoch").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("spans"))
    whole = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("d"), F.col(quoted(id_col)).cast("long").alias("of"), row_hash(docs).alias("of_row"))
    if rows.where("copies > 1").take(1):
        whole = whole.dropDuplicates(["of", "of_row"])  # wholly equal rows: their copies have spans of their own
    joined = whole.join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row"))).select(F.col("d." + quoted(text_col)).alias("text"), "spans", "d")
    names, at = docs.columns, place_of(docs, text_col)

    def cut(batches):
        for b in (part for whole in batches for part in text_slices(whole, 0)):
            texts = [_taken(t or b"", s) for t, s in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist())]
            columns = [pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()) if i == at else c for i, c in enumerate(b.column(2).flatten())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    out = joined.mapInArrow(cut, docs.schema)
    return out.withColumn(chars_col, F.length(quoted(text_col)).cast(docs.schema[chars_col].dataType)) if chars_col in names else out


def _taken(text: bytes, spans: list[dict]) -> bytes:
    """The passages of the word spans; spans that touch are one, and the whole text is left as it is."""
    runs: list[list[int]] = []
    for s in spans:
        if runs and runs[-1][1] == s["at"]:
            runs[-1][1] += s["words"]
        else:
            runs.append([s["at"], s["at"] + s["words"]])
    x = np.frombuffer(text, np.uint8)
    space = (x == 32) | ((x >= 9) & (x <= 13))
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(x) else np.zeros(0, np.int64)
    if len(runs) == 1 and runs[0] == [0, len(starts)]:
        return text
    ends = np.flatnonzero(~space & np.r_[space[1:], True])
    return b"\n".join(text[starts[a] : ends[b - 1] + 1] for a, b in runs)
