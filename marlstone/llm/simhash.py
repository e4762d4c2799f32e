"""SimHash near-duplicates, found with a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed, quoted, row_hash, sorted_groups
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Rows of one group of the index that a task searches at once.
GROUP_CAP = 32_768
FANOUT = 16
#: Fingerprints that go down the index together.
ASKED = 256


def fingerprint_words(words: list[bytes], k: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a list of words: a bit is set if it is set in over half the shingle hashes."""
    import xxhash

    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    if n <= k:
        return xxhash.xxh64_intdigest(text, seed)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    starts = (end - size)[: n - k + 1].tolist()
    ends = end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], seed) for a, b in zip(starts, ends)], np.uint64)
    set_bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a (signed) long; null and empty texts have 0."""

    def factory():
        def compute(texts):
            return [np.array([fingerprint_words(t.lower().split()) for t in texts], np.uint64).view(np.int64)]

        return compute

    return append_columns(docs, text_col, [T.StructField(out, T.LongType())], factory)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the binary-reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Fingerprints sorted by Gray rank; each upper node keeps the bits that all fingerprints below it share.

    ``mask`` has the shared bit positions of a node and ``pattern`` their values. The differences between a query and
    the pattern under the mask accumulate on the way down, so that a node beyond the limit drops its whole group; one
    that differs in the ``head`` bits drops it at once. ``visited`` and ``pruned`` count nodes.
    """

    def __init__(self, x: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(x), kind="stable")
        self.leaf = x[self.order]
        self.fanout = fanout
        self.visited = self.pruned = 0
        every, some = self.leaf, self.leaf
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(every) > fanout:
            cut = np.arange(0, len(every), fanout)
            every, some = np.bitwise_and.reduceat(every, cut), np.bitwise_or.reduceat(some, cut)
            mask = every | ~some
            self.levels.append((mask, every & mask))
        self.levels.reverse()

    def within(self, q: np.ndarray, bits: int = MAX_BITS, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index into q, index into x) of all pairs at ``bits`` differing bits or fewer, none of them in ``head``."""
        n_top = len(self.levels[0][0]) if self.levels else len(self.leaf)
        qi = np.repeat(np.arange(len(q)), n_top)
        node = np.tile(np.arange(n_top), len(q))
        head = np.uint64(head)
        for depth, (mask, pattern) in enumerate(self.levels):
            differ = (q[qi] ^ pattern[node]) & mask[node]
            near = (np.bitwise_count(differ) <= bits) & (differ & head == 0)
            self.visited += len(near)
            self.pruned += len(near) - int(near.sum())
            qi, node = qi[near], node[near]
            below = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.leaf)
            child = node[:, None] * self.fanout + np.arange(self.fanout)
            real = child < below
            qi, node = np.broadcast_to(qi[:, None], child.shape)[real], child[real]
        differ = q[qi] ^ self.leaf[node]
        near = (np.bitwise_count(differ) <= bits) & (differ & head == 0)
        return qi[near], self.order[node[near]]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; label holds the smallest member of each class."""
    while True:
        la, lb = label[a], label[b]
        m = la != lb
        if not m.any():
            return label
        a, b, la, lb = a[m], b[m], la[m], lb[m]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _blocks(bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of bits + 1 blocks: of a pair within ``bits``, one block is equal."""
    edges = [round(64 * i / (bits + 1)) for i in range(bits + 2)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _star(t: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group, a star per class: inside it, or, for a pair of groups, between its sides 0 and 1."""
    table, side = t.column("table").to_numpy(), t.column("side").to_numpy()
    x, node = t.column("x").to_numpy().view(np.uint64), t.column("node").to_numpy()
    label = np.arange(len(x))
    for k, (_, width) in enumerate(_blocks(bits)):
        asked, stored = np.flatnonzero((table == k) & (side == 0)), np.flatnonzero((table == k) & (side == 1))
        stored = asked if t.column("a")[0] == t.column("b")[0] else stored
        if not len(asked) or not len(stored):
            continue
        index = GrayIndex(x[stored])
        head = ((1 << width) - 1) << (64 - width)
        asked = asked[np.argsort(gray_rank(x[asked]), kind="stable")]
        for i in range(0, len(asked), ASKED):
            q = asked[i : i + ASKED]
            qi, xi = index.within(x[q], bits, head)
            label = _merge(label, q[qi], stored[xi])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return node[linked], node[label[linked]]


def _rank(x: Column) -> Column:
    """The Gray rank of a long's bits, as a long that sorts like it."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def gray_table(fps: DataFrame, bits: int = MAX_BITS, cap: int = GROUP_CAP) -> DataFrame:
    """The index over a table of distinct ``fp``: (node, table, x, head, rank, group), kept, so that groups stay as they are.

    Table i has the fingerprints turned so that block i leads, in Gray order: those with an equal block lie next to
    each other. Ranges of that order, of about ``cap`` rows each, are the groups. Ranks are distinct in a table, so any
    number of fingerprints that are much alike is cut evenly.
    """
    turned = []
    for k, (lo, width) in enumerate(_blocks(bits)):
        x = F.shiftleft("fp", lo).bitwiseOR(F.shiftrightunsigned("fp", 64 - lo)) if lo else F.col("fp")
        turned.append(F.struct(F.lit(k).alias("table"), x.alias("x"), F.shiftrightunsigned(x, 64 - width).alias("head"), _rank(x).alias("rank")))
    rows = fps.select(F.col("fp").alias("node"), F.explode(F.array(*turned)).alias("t")).select("node", "t.*")
    groups = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * (bits + 1) // cap))
    return checkpointed(rows.repartitionByRange(groups, "table", "rank").withColumn("group", F.spark_partition_id()))


def group_pairs(index: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(table, head, group, other, mask, pattern): which groups a block's fingerprints must still be sought in.

    A block whose fingerprints fill several groups (of the at most (bits + 1) * 2**16 blocks those at the groups' ends)
    pairs these groups. Each group is an upper node with the bits that all below it share; pairs of nodes whose shared
    bits differ too often are dropped whole. mask and pattern are the other node's.
    """
    shared = index.groupBy("group").agg(F.bit_and("x").alias("every"), F.bit_or("x").alias("some"))
    nodes = shared.select("group", F.col("every").bitwiseOR(F.bitwise_not("some")).alias("mask"), "every").withColumn("pattern", F.col("every").bitwiseAND(F.col("mask"))).drop("every")
    wide = index.groupBy("table", "head").agg(F.min("group").alias("first"), F.max("group").alias("last")).where("first < last")
    each = F.sequence("first", "last")
    pairs = wide.select("table", "head", F.explode(each).alias("group"), "first", "last").select("table", "head", "group", F.explode(each).alias("other")).where("group <> other")
    own = nodes.select("group", F.col("mask").alias("own_mask"), F.col("pattern").alias("own_pattern"))
    met = pairs.join(own, "group").join(nodes.withColumnRenamed("group", "other"), "other")
    apart = F.bit_count(F.col("own_pattern").bitwiseXOR(F.col("pattern")).bitwiseAND(F.col("own_mask")).bitwiseAND(F.col("mask")))
    return met.where(apart <= bits).select("table", "head", "group", "other", "mask", "pattern")


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS, cap: int = GROUP_CAP) -> DataFrame:
    """Links (u, v) between distinct ``fp`` that keep all fingerprints within ``bits`` connected.

    Every group of the Gray-order index is searched by its own rows, and by those rows of other groups that share a
    block with rows of it and that its node does not prune. Of the classes found a star is kept, never all pairs.
    """
    index = gray_table(fps, bits, cap)
    columns = ["table", "x", "node", "rank"]
    home = index.select(F.col("group").alias("a"), F.col("group").alias("b"), F.lit(0).alias("side"), *columns)
    sent = index.join(group_pairs(index, bits), ["table", "head", "group"]).where(F.bit_count(F.col("x").bitwiseXOR(F.col("pattern")).bitwiseAND(F.col("mask"))) <= bits)
    sent = sent.select(F.least("group", "other").alias("a"), F.greatest("group", "other").alias("b"), (F.col("group") > F.col("other")).cast("int").alias("side"), *columns)
    keys = ["a", "b"]

    def run(batches):
        for t in sorted_groups(batches, keys):
            # A table may hold several groups, each of them whole.
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            for lo, hi in zip(cut, np.r_[cut[1:], len(a)]):
                u, v = _star(t.slice(lo, hi - lo).combine_chunks(), bits)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return home.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys, "table", "rank").mapInArrow(run, "u long, v long")


def _grouped(fps: DataFrame, bits: int, cap: int) -> DataFrame:
    """``fps`` (doc_id, fp, ..) with group, a fingerprint that names the component, and component_id, its smallest id."""
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = checkpointed(connected_components(fingerprint_links(classes.select("fp"), bits, cap)))
    least = found.join(classes, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("rep").alias("least"))
    members = found.join(least, "component").select("node", "component", "least")
    known = classes.join(members, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "fp").alias("group"), F.coalesce("least", "rep").alias("component_id"))
    return fps.join(known, F.col("fp") == F.col("of")).drop("of")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS, cap: int = GROUP_CAP) -> DataFrame:
    """One row (doc_id, fp, component_id) per document; component_id is the smallest id reachable over links.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows give repeated results; rows whose
    id is null belong to the component of their fingerprint, whose id is null if no member has one. Equal fingerprints
    are one class, compared once; texts may be of any length; other columns are not read; an empty table gives no rows.
    """
    fps = checkpointed(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "fp"))
    return _grouped(fps, bits, cap).select("doc_id", "fp", "component_id")


def hexadecimal(col: str):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS, cap: int = GROUP_CAP) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: the first by id (null last), then by a hash of the row.

    Rows that repeat an id with different texts are documents of their own; of wholly equal rows one stays. Null and
    empty texts are one group. All columns stay as they are, whatever their names.
    """
    row_id = F.col(quoted(id_col)).cast("long")
    row = row_hash(docs)
    fps = checkpointed(fingerprints(docs.select(row_id.alias("doc_id"), F.col(quoted(text_col)).alias("text"), row.alias("row"))).select("doc_id", "row", "fp"))
    first = _grouped(fps, bits, cap).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("k"))
    keep = first.select(F.col("k.doc_id").alias("id"), F.col("k.row").alias("row"))
    whole = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("d"), row_id.alias("id"), row.alias("row"))
    kept = whole.alias("w").join(keep.alias("k"), F.col("w.id").eqNullSafe(F.col("k.id")) & (F.col("w.row") == F.col("k.row")), "left_semi")
    if fps.groupBy("doc_id", "row").count().where("count > 1").take(1):
        kept = kept.dropDuplicates(["id", "row"])
    return kept.select("d.*")
