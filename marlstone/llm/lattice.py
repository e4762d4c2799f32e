"""Embedding near-duplicates by lattice hashing: random projections decoded to points of the E8 lattice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, quoted, sorted_groups
from .components import connected_components
from .simhash import _merge

TABLES = 3
PROBES = 4
#: Length of a unit vector after projection and scaling, in units of the lattice (whose points are sqrt 2 apart).
#: A larger one makes cells smaller: for far more vectors raise it together with the tables, which keep up recall.
SCALE = 1.5
MIN_COSINE = 0.9
SEED = 8
#: Rows of one cell that a task compares at once; larger cells are dealt out as pairs of chunks.
GROUP_CAP = 4096
#: Cells over that size whose table is broadcast.
BROADCAST_CELLS = 100_000
#: Projections are whole numbers of so many parts, so that a vector's cells come out alike wherever they are computed.
PARTS = 1 << 14


def decode_e8(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of 8 numbers, times two (so that it is whole).

    E8 is D8 (whole numbers with an even sum) and D8 shifted by one half; the nearer of the two candidates wins.
    """

    def d8(z):
        r = np.rint(z)
        gap = z - r
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        worst = np.abs(gap[odd]).argmax(axis=1)
        r[odd, worst] += np.where(gap[odd, worst] < 0, -1, 1)
        return r

    a, b = d8(y), d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return (2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def e8_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, times two: two coordinates +-1, or all +-1/2 with an even number of minus signs."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i) for a in (2, -2) for b in (2, -2)]
    out = np.zeros((len(pairs), 8), np.int64)
    for k, (i, j, a, b) in enumerate(pairs):
        out[k, [i, j]] = a, b
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([out, signs[signs.prod(axis=1) == 1]])


def _cell(point: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name for lattice points (times two) of one table; different points get different names.

    Coordinates are at most twice SCALE in size, so that each fits in 7 bits.
    """
    out = np.full(point.shape[:-1], table, np.int64)
    for k in range(8):
        out = (out << 7) | (point[..., k] + 64)
    return out


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, unit, error) of unit vectors: whole components from -127 to 127, what one is worth, and the distance that this moves a vector."""
    unit = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / unit[:, None]).astype(np.int8)
    return codes, unit, np.linalg.norm(x - codes * unit[:, None], axis=1) + 1e-9


def signatures(codes: np.ndarray, unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(home, probe) of quantised unit vectors: per table the own cell, and the cells of the nearest neighbouring points."""
    if tables > 127 or scale > 15:
        raise ValueError("cells are named by 7 bits a coordinate and a table")
    rng = np.random.default_rng(seed)
    x = codes.astype(np.float64)
    d = x.shape[1]
    near = e8_neighbours()
    homes, around = [], []
    for t in range(tables):
        p = np.rint(np.linalg.qr(rng.standard_normal((max(d, 8), 8)))[0][:d] * PARTS)
        # Sums of whole numbers are exact, in whatever order they are taken.
        y = (x @ p) * (unit / PARTS * scale * max(1.0, np.sqrt(d / 8)))[:, None]
        y = np.clip(y, -15, 15)
        home = decode_e8(y)
        # Distance to home + n, less that to home: |n|^2 - 2 n (y - home); all n are equally long.
        gain = np.round((y - home / 2) @ (near / 2).T, 9)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        homes.append(_cell(home, t))
        around.append(_cell(home[:, None, :] + near[best], t))
    return np.stack(homes, axis=1), np.stack(around, axis=1)


def _met(a_home, b_home, a_probe, b_probe, tables) -> np.ndarray:
    """(pairs, tables): whether two vectors meet in a table, one in the home or a probed cell of the other."""
    same = a_home == b_home
    for t in range(tables):
        same[:, t] |= (a_probe[:, t] == b_home[:, t, None]).any(axis=1) | (b_probe[:, t] == a_home[:, t, None]).any(axis=1)
    return same


class _Verified:
    """Gathers pairs of rows and keeps each pair of classes in the cell where it meets first, there once.

    Linked pairs are counted and leave a star; pairs that the quantised vectors leave open are kept themselves.
    """

    def __init__(self, cell, kind, node, copies, sign):
        self.cell, self.kind, self.node, self.copies, self.sign = cell, kind, node, copies, sign
        self.links, self.label = np.zeros(len(node), np.int64), np.arange(len(node))
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, q, s, sure):
        # Two rows at home meet twice, as (q, s) and (s, q): the smaller node asks.
        real = (self.node[q] != self.node[s]) & ((self.kind[q] == 1) | (self.node[q] < self.node[s]))
        self.pairs.append((q[real], s[real], sure[real]))
        self.held += int(real.sum())
        if self.held > 500_000:
            self.flush()

    def flush(self):
        if not self.held:
            return
        q, s, sure = (np.concatenate(x) for x in zip(*self.pairs))
        self.pairs, self.held = [], 0
        rows, at = np.unique(np.r_[q, s], return_inverse=True)
        home, probe = self.sign(rows)
        a, b = at[: len(q)], at[len(q) :]
        table = self.cell[q] >> 56
        # Where each of a pair probes the other's home they meet in two cells: the smaller node asks.
        mutual = (self.kind[q] == 1) & (probe[b, table] == home[a, table, None]).any(axis=1)
        before = (_met(home[a], home[b], probe[a], probe[b], home.shape[1]) & (np.arange(home.shape[1]) < table[:, None])).any(axis=1)
        keep = ~before & (~mutual | (self.node[q] < self.node[s]))
        self.open.append((self.node[q[keep & ~sure]], self.node[s[keep & ~sure]]))
        q, s = q[keep & sure], s[keep & sure]
        np.add.at(self.links, q, self.copies[s])
        np.add.at(self.links, s, self.copies[q])
        self.label = _merge(self.label, q, s)

    def rows(self):
        """(node, other, links, open) arrays."""
        self.flush()
        some = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        a, b = (np.concatenate(x) for x in zip(*self.open)) if self.open else (np.zeros(0, np.int64),) * 2
        return np.r_[self.node[some], a], np.r_[self.node[self.label[some]], b], np.r_[self.links[some], np.zeros(len(a), np.int64)], np.r_[np.zeros(len(some), bool), np.ones(len(a), bool)]


def _links(t: pa.Table, least: float, sign):
    """Rows of one cell or pair of its chunks: how many vectors a class links with, a star of its cells, and open pairs.

    The product of two quantised vectors is off by at most the sum of their errors, and decides unless ``least`` lies
    that near.
    """
    n = t.num_rows
    column = lambda name: t.column(name).to_numpy()
    kind, side, unit, error = map(column, ("kind", "side", "unit", "error"))
    codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(n, -1)
    x = (codes * unit[:, None]).astype(np.float32)
    v = _Verified(column("cell"), kind, column("node"), column("copies"), lambda rows: sign(codes[rows], unit[rows]))
    at, home = np.arange(n), kind == 0
    one = t.column("chunk_a")[0] == t.column("chunk_b")[0]
    deals = [(at, at[home])] if one else [(at[side == k], at[home & (side == 1 - k)]) for k in (0, 1)]
    for asked, stored in deals:
        for i in range(0, len(asked) if len(stored) else 0, 256):
            a = asked[i : i + 256]
            dot = x[a] @ x[stored].T
            slack = error[a][:, None] + error[stored] + error[a][:, None] * error[stored] + 1e-5
            r, c = np.nonzero(dot >= least - slack)
            v.add(a[r], stored[c], dot[r, c] >= least + slack[r, c])
    return v.rows()


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at length one; divided by their largest component first, lest squares overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    """Neither null nor empty, no null or non-finite component, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _by_length(b: pa.RecordBatch, column: str):
    """(rows, matrix) of the vectors of each length in a batch."""
    lists = b.column(column)
    size = lists.value_lengths().to_numpy()
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _quantized(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, h1, h2, vec) with codes, unit and error in place of the vector."""

    def run(batches):
        for b in batches:
            for at, x in _by_length(b, "vec") if b.num_rows else ():
                codes, unit, error = quantize(_unit(x))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("vec_id", "h1", "h2")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(unit), pa.array(error)], names=["vec_id", "h1", "h2", "codes", "unit", "error"])

    return rows.mapInArrow(run, "vec_id long, h1 long, h2 long, codes binary, unit double, error double")


def _cosines(pairs: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, x, y) whose vectors have a cosine of ``least`` or more in double precision."""

    def run(batches):
        for b in batches:
            for at, x in _by_length(b, "x") if b.num_rows else ():
                y = b.column("y").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(x.shape)
                yield b.select(["a", "b"]).take(pa.array(at[(_unit(x) * _unit(y)).sum(axis=1) >= least]))

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = MIN_COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED, cap: int = GROUP_CAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links at a cosine of ``least`` or more in double precision.

    Equal vectors are one class, with its smallest id and its number of copies; copies link with each other and are not
    expanded into pairs. Classes meet in the cells of ``tables`` lattices: each is stored in its own cell and asks in
    that and in ``probes`` neighbouring ones; only vectors of one length meet. What travels to a cell is a byte for
    each component, with the error this makes: it decides all pairs but those within the error of ``least``, and these
    are compared by their whole vectors. Pairs are counted where they first meet and leave a star per cell, so the
    rows made grow with the vectors, not with the pairs. A cell of over ``cap`` rows is dealt out as pairs of chunks.
    Pairs that never meet are missed; none below ``least`` is linked. Vectors that are null, empty, zero, or hold null
    or non-finite components link with nothing. Repeated rows count as copies; rows with a null id count as vectors,
    and have a null component unless their component has an id; other columns are not read; an empty table has no rows.
    """
    base = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).alias("vec"))
    usable = _usable(F.col("vec"))
    base = base.select("vec_id", "vec", F.when(usable, F.xxhash64("vec")).alias("h1"), F.when(usable, F.xxhash64("vec", F.lit(1))).alias("h2"))
    given = base.where("h1 is not null")
    classes = _quantized(given).groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("codes", "unit", "error")])
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def sign(codes, unit):
        return signatures(codes, unit, tables, probes, scale, seed)

    kinds = np.r_[np.zeros(tables, np.int32), np.ones(tables * probes, np.int32)]

    def place(batches):
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                size = np.array([len(c) for c in b.column("codes").to_pylist()])
                for d in np.unique(size):
                    rows = b.take(pa.array(np.flatnonzero(size == d)))
                    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int8).reshape(rows.num_rows, d)
                    home, probe = sign(codes, rows.column("unit").to_numpy())
                    both = np.concatenate([home, probe.reshape(len(home), -1)], axis=1)
                    out = rows.take(pa.array(np.repeat(np.arange(len(both)), both.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(both.reshape(-1)), pa.array(np.full(out.num_rows, d, np.int32)), pa.array(np.tile(kinds, len(both))), *out.columns], names=["cell", "d", "kind", *out.schema.names])

    fields = ["node", "copies", "codes", "unit", "error"]
    cells = classes.select(*fields).mapInArrow(place, "cell long, d int, kind int, node long, copies long, codes binary, unit double, error double")
    hot = cells.groupBy("cell", "d").count().where(F.col("count") > cap).select("cell", "d", F.ceil(F.col("count") / cap).cast("int").alias("chunks"))
    hot = kept(hot, "hot")  # of each cap rows one at most
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_CELLS else hot
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("chunks"))).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = cells.join(hot, ["cell", "d"], "left").withColumn("chunk", chunk).withColumn("other", other)
    dealt = dealt.select("cell", "d", F.least("chunk", "other").alias("chunk_a"), F.greatest("chunk", "other").alias("chunk_b"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "kind", *fields)
    keys = ["cell", "d", "chunk_a", "chunk_b"]

    def verify(batches):
        for t in sorted_groups(batches, keys):
            # A table may hold several groups, each of them whole.
            key = np.stack([t.column(k).to_numpy() for k in keys])
            cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            got = [_links(t.slice(lo, hi - lo), least, sign) for lo, hi in zip(cut, np.r_[cut[1:], t.num_rows]) if hi - lo > 1]
            if got:
                node, other, n, unsure = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(n), pa.array(unsure)], names=["node", "other", "n", "open"])

    found = kept(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "node long, other long, n long, open boolean"), "found")
    links = found.where("not open").select("node", "other", "n")
    open_pairs = found.where("open").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if open_pairs.take(1):
        asked = open_pairs.select(F.col("a").alias("node")).union(open_pairs.select("b")).distinct()
        whole = asked.join(classes.select("node", "h1", "h2", "copies"), "node").join(given.select("h1", "h2", "vec"), ["h1", "h2"]).groupBy("node").agg(F.first("copies").alias("copies"), F.first("vec").alias("vec"))
        whole = kept(whole, "open")
        close = open_pairs.join(whole.select(F.col("node").alias("a"), F.col("vec").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b")
        close = kept(_cosines(close.select("a", "b", "x", "y"), least), "close")
        both = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = both.join(whole.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("copies").alias("n"))
        links = kept(links.unionByName(more), "links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    comps = kept(connected_components(links.select(F.col("node").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "member"), "comps")
    least_id = comps.join(classes, F.col("member") == F.col("node")).groupBy("component").agg(F.min("rep").alias("least"))
    members = comps.join(least_id, "component").select("member", "least")
    of = classes.join(counts, "node", "left").join(members, F.col("node") == F.col("member"), "left")
    of = of.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = base.select("vec_id", "h1", "h2").join(of, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
