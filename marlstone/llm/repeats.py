"""Bytes of texts that lie in a string of a given length which occurs more than once in a corpus.

Suffixes are compared only where a repeat is possible. Each window of ``span`` bytes is governed by its anchor, the
gram in it with the least hash; equal windows have equal anchors at equal places, so that repeats are sought among
suffixes whose anchors share a bucket. Buckets of anchors whose stretches are all alike, or all alone, are settled by
counts. In the others the suffixes of the stretches are sorted by bucket-pointer refinement: buckets of 8 bytes are
split by the bucket pointers of the suffixes 8 bytes further on, those of 16 bytes by pointers 16 further on, and so
on to the whole span, each round using the pointers that the last has left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, append_columns, kept, kept_buckets, quoted, read, sorted_groups, text_slices, unused, without  # noqa: F401

SPAN = 200
#: Bytes of an anchor's gram; shorter spans take half of theirs.
GRAM = 32
#: A long text is taken in pieces of so many windows.
PIECE = 1 << 20
#: Different stretches around one anchor that are sorted together (2 MB); windows of larger buckets are counted by digests.
LIMIT = 8192
#: Bytes of stretches that are sorted at once, unless one bucket has more.
SORTED = 1 << 20
MIX = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(32))


class GramHashes:
    """Hashes of all grams of a buffer: differences of running sums of byte values times powers, modulo 2**64."""

    def __init__(self, gram: int):
        self.gram, self.value = gram, _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX))
        self.power = self.inverse = np.ones(1, np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if len(self.power) < len(x):
            n = max(len(x), 2 * len(self.power))
            self.power, self.inverse = (np.cumprod(np.full(n, b, np.uint64)) for b in (MIX, pow(MIX, -1, 1 << 64)))
        sums = np.cumsum(self.value[x] * self.power[: len(x)])
        ahead = sums[self.gram - 1 :].copy()
        ahead[1:] -= sums[: len(ahead) - 1]
        return _mixed(ahead * self.inverse[: len(ahead)])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by minima of powers of two."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def anchors(pieces: list[bytes], span: int, hashes: GramHashes) -> tuple[np.ndarray, ...]:
    """(piece, lo, hi, bucket, stretch) of every anchor: it governs the windows that start at lo to hi of its piece.

    bucket is the hash of its gram, stretch that of all bytes of its windows. Every piece is at least a span long.
    """
    lengths = np.array([len(t) for t in pieces])
    whole = b"".join(pieces)
    ends = np.cumsum(lengths)
    hashed = hashes(np.frombuffer(whole, np.uint8))
    # The hash orders, then the place: the first of equal grams is the anchor.
    order = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    at = (_least(order, span - hashes.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), lengths)[: len(at)]
    start = np.flatnonzero(np.arange(span, span + len(at)) <= ends[piece])
    at = at[start]
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    lo, hi, piece = start[cut], start[np.r_[cut[1:], len(start)] - 1], piece[start[cut]]
    stretch = np.fromiter((xxhash.xxh3_64_intdigest(whole[a : b + span]) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
    base = (ends - lengths)[piece]
    return piece, lo - base, hi - base, hashed[at[cut]].view(np.int64), stretch.view(np.int64)


def _split(old: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, pointer, many): suffixes sorted inside their buckets, the start of each new bucket, and if it has two or more."""
    order = np.lexsort((ahead, old))
    old, ahead = old[order], ahead[order]
    was = np.r_[True, old[1:] != old[:-1]]
    now = was | np.r_[True, ahead[1:] != ahead[:-1]]
    place = np.arange(len(old))
    heads = np.flatnonzero(now)
    sizes = np.diff(np.r_[heads, len(old)])
    pointer = old + np.repeat(heads, sizes) - np.maximum.accumulate(np.where(was, place, 0))
    return order, pointer, np.repeat(sizes > 1, sizes)


def repeated(x: np.ndarray, room: np.ndarray, span: int) -> np.ndarray:
    """Places of ``x`` whose next ``span`` bytes occur at another place too; ``room`` is the bytes left in each's stretch.

    A place whose bucket it fills alone is settled, and so is one without room; the rest are split by the pointers of
    the places ``step`` further on, which the round before has brought to the same depth.
    """
    depth = min(8, span)
    live = np.flatnonzero(room >= depth)
    padded = np.r_[x, np.zeros(8, np.uint8)].astype(np.uint64)
    gram = np.zeros(len(x), np.uint64)
    for k in range(depth):
        gram |= padded[k : k + len(x)] << np.uint64(8 * k)
    pointer = np.zeros(len(x), np.int64)
    order, start, many = _split(np.zeros(len(live), np.int64), gram[live])
    live = live[order]
    pointer[live] = start
    live = live[many]
    while depth < span:
        step = min(depth, span - depth)
        live = live[room[live] >= depth + step]
        order, start, many = _split(pointer[live], pointer[live + step])
        live = live[order]
        pointer[live] = start
        live = live[many]
        depth += step
    return live


def _key(text: bytes) -> tuple[int, int]:
    d = hashlib.sha256(text).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)


KEY = ["k1", "k2"]
KEY_FIELDS = [T.StructField(k, T.LongType()) for k in KEY]


def _keyed(docs: DataFrame, fields: list[T.StructField], more) -> DataFrame:
    """``docs`` with the two halves of its text's 128-bit digest, and further columns of each text by ``more``."""

    def factory():
        def compute(texts):
            keys = [_key(t) for t in texts]
            return [[k[0] for k in keys], [k[1] for k in keys], *(list(c) for c in zip(*map(more, texts)))] if texts else [[]] * (2 + len(fields))

        return compute

    return append_columns(docs, "text", [*KEY_FIELDS, *fields], factory)


def _anchor_rows(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(k1, k2, lo, hi, bucket, stretch) of all anchors of a table of texts (k1, k2, text)."""
    names = ["k1", "k2", "lo", "hi", "bucket", "stretch"]

    def rows(pieces, hashes):
        which, lo, hi, bucket, stretch = anchors([p for _, _, _, p in pieces], span, hashes)
        k1, k2, base = (np.array([p[i] for p in pieces], np.int64)[which] for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (k1, k2, lo + base, hi + base, bucket, stretch)], names=names)

    def run(batches):
        hashes, held, size = GramHashes(gram), [], 0
        for b in batches:
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                for base in range(0, len(text) - span + 1, PIECE):
                    held.append((k1, k2, base, text[base : base + PIECE + span - 1]))
                    size += len(held[-1][3])
                    if size >= PIECE:
                        yield rows(held, hashes)
                        held, size = [], 0
        if held:
            yield rows(held, hashes)

    return texts.select("k1", "k2", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _stretches(classes: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """``classes`` (k1, k2, lo, hi, bucket, n, k) with the bytes of each stretch, read from the texts."""
    asked = classes.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", "bucket", "n", "k")).alias("asked"))

    def run(batches):
        for b in batches:
            out = []
            for k1, k2, asked, text in zip(*(b.column(i) for i in range(4))):
                k1, k2, text = k1.as_py(), k2.as_py(), text.as_py()
                out += [(k1, k2, a["lo"], a["bucket"], a["n"], a["k"], text[a["lo"] : a["hi"] + span]) for a in asked.as_py()]
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

    names = ["k1", "k2", "lo", "bucket", "n", "k", "bytes"]
    schema = pa.schema([*((n, pa.int64()) for n in names[:-1]), ("bytes", pa.binary())])
    return texts.join(asked, KEY).select(*KEY, "asked", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", bytes binary")


SPANS = "k1 long, k2 long, start long, end long"


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring places, which are in order."""
    heads = np.flatnonzero(np.r_[True, np.diff(places) != 1]) if len(places) else places
    return places[heads], places[np.r_[heads[1:], len(places)].astype(np.int64) - 1] if len(places) else places


def _sorted_spans(stretches: DataFrame, span: int) -> DataFrame:
    """Spans (k1, k2, start, end) of the repeated windows of stretches that are alone in their class, by buckets."""

    def settle(t):
        lengths = t.column("bytes").combine_chunks() if isinstance(t.column("bytes"), pa.ChunkedArray) else t.column("bytes")
        texts = lengths.to_pylist()
        size = np.array([len(x) for x in texts])
        ends = np.cumsum(size)
        room = np.repeat(ends, size) - np.arange(ends[-1])
        live = np.sort(repeated(np.frombuffer(b"".join(texts), np.uint8), room, span))
        of = np.searchsorted(ends, live, "right")
        alone = t.column("n").to_numpy()[of] == 1
        live, of = live[alone], of[alone]
        # A window at a stretch's end and one at the next one's start are never neighbours: a span lies between them.
        first, last = _runs(live)
        row = np.searchsorted(ends, first, "right")
        shift = t.column("lo").to_numpy()[row] - (ends - size)[row]
        return pa.RecordBatch.from_arrays([pa.array(t.column(k).to_numpy()[row]) for k in KEY] + [pa.array(first + shift), pa.array(last + shift + span)], names=["k1", "k2", "start", "end"])

    def run(batches):
        for t in sorted_groups(batches, ["bucket"]):
            bucket = t.column("bucket").to_numpy()
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.cumsum(np.array([len(x.as_py()) for x in t.column("bytes")]))
            part = np.r_[0, size][heads] // SORTED
            cuts = heads[np.r_[True, part[1:] != part[:-1]]]
            for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)]):
                yield settle(t.slice(a, b - a))

    return stretches.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SPANS)


def _counted_spans(stretches: DataFrame, span: int) -> DataFrame:
    """The same for buckets with very many different stretches: every window by its 128-bit digest, counted."""
    names = ["w1", "w2", "k1", "k2", "at", "n"]

    def run(batches):
        for b in batches:
            for k1, k2, lo, n, text in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "lo", "n", "bytes"))):
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[i : i + span]) for i in range(len(text) - span + 1)), ">i8").astype(np.int64).reshape(-1, 2)
                full = [np.full(len(d), v, np.int64) for v in (k1, k2)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), *full, lo + np.arange(len(d)), np.full(len(d), n, np.int64))], names=names)

    windows = kept(stretches.mapInArrow(run, ", ".join(f"{n} long" for n in names)), "windows")
    often = kept(windows.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").select("w1", "w2"), "often")
    return windows.where("n = 1").join(often, ["w1", "w2"]).select(*KEY, F.col("at").alias("start"), (F.col("at") + span).alias("end"))


def repeated_spans(texts: DataFrame, span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """(k1, k2, start, end): byte ranges that cover exactly the repeated windows of a table of different texts.

    Anchors are shuffled twice, as numbers: to count their buckets, and to meet the buckets that have two or more. Of
    a bucket with different stretches one stretch of each kind is read from the texts; up to ``limit`` kinds are
    sorted in one task, windows of larger buckets are dealt by their digests, so that no bucket is gathered whole.
    """
    gram = GRAM if span >= 2 * GRAM else max(1, span // 2)
    rows = _anchor_rows(texts, span, gram)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("all"), (F.min("stretch") != F.max("stretch")).alias("differ")).where("all > 1")
    met = kept(rows.join(kept(counts.select("bucket", "differ"), "buckets"), "bucket"), "met")
    alike = met.where("not differ").select(*KEY, F.col("lo").alias("start"), (F.col("hi") + span).alias("end"))
    mixed = met.where("differ")
    classes = kept(mixed.groupBy("bucket", "stretch").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*KEY, "lo", "hi")]), "classes")
    twice = kept(classes.where("n > 1").select("bucket", "stretch"), "twice")
    shared = mixed.join(twice, ["bucket", "stretch"]).select(*KEY, F.col("lo").alias("start"), (F.col("hi") + span).alias("end"))
    kinds = kept(classes.groupBy("bucket").agg(F.count("*").alias("k")), "kinds")
    stretches = kept(_stretches(classes.join(kinds, "bucket").drop("stretch"), texts, span), "stretches")
    out = alike.unionByName(shared).unionByName(_sorted_spans(stretches.where(F.col("k") <= limit), span))
    large = stretches.where(F.col("k") > limit)
    return out.unionByName(_counted_spans(large, span)) if large.take(1) else out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as ranges that neither meet nor touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    heads = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return starts[heads], ends[np.r_[heads[1:], len(ends)] - 1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, limit: int = LIMIT, content: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per document, whose UTF-8 bytes in repeated strings are removed.

    Removed is every byte in a string of ``span`` bytes that also starts elsewhere in the corpus, in the same text or
    another, overlaps included, as judged on the input. With ``content``, ``spans`` (the removed byte ranges) and
    ``kept`` (the bytes left, which may cut a character) come with it. Null and empty texts have no bytes; equal texts
    of at least a span are removed whole; repeated and null ids are documents of their own; texts may be of any length;
    other columns are not read; an empty table gives no rows. Equality of texts, and of windows in crowded buckets, is
    that of 128-bit digests.
    """
    given = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    known = kept(_keyed(given, [T.StructField("n_bytes", T.LongType()), T.StructField("sha", T.StringType())], lambda t: (len(t), hashlib.sha256(t).hexdigest())).drop("text"), "known")
    long_enough = given.select("text").where(F.octet_length("text") >= span)
    texts = kept_buckets(_keyed(long_enough, [], lambda t: ()).groupBy(*KEY).agg(F.first("text").cast("binary").alias("text")), "texts", KEY, "zstd")
    spans = repeated_spans(texts, span, limit).groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    copies = known.where(F.col("n_bytes") >= span).groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1")
    found = texts.join(spans, KEY).select(*KEY, "spans", "text")

    def cut(batches):
        for b in (part for whole in batches for part in text_slices(whole, 3)):
            out = []
            for spans, text in zip(b.column(2), b.column(3)):
                pairs, text = spans.values.flatten(), text.as_py()
                starts, ends = merged(pairs[0].to_numpy(), pairs[1].to_numpy())
                left = b"".join(text[a:z] for a, z in zip(np.r_[0, ends], np.r_[starts, len(text)]))
                out.append((int((ends - starts).sum()), len(starts), hashlib.sha256(left).hexdigest(), [{"start": a, "end": z} for a, z in zip(starts.tolist(), ends.tolist())] if content else None, left if content else None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=names)

    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types, names = [pa.int64(), pa.int64(), pa.string(), ranges, pa.binary()], [*KEY, "n_removed", "n_spans", "left_sha", "spans", "kept"]
    cuts = found.mapInArrow(cut, "k1 long, k2 long, n_removed long, n_spans long, left_sha string, spans array<struct<start: long, end: long>>, kept binary")
    facts = kept(copies.join(cuts, KEY, "full"), "facts")
    out = known.join(facts, KEY, "left")
    all_of = F.col("copies").isNotNull()
    base = out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(all_of, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_of, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_of, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        *([F.when(all_of, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.col("spans")).alias("spans"), F.when(all_of, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if content else []),
    )
    return base
