"""Vectors as codes of a byte per part: integer k-means per part, searched through memoised grid cells.

The nearest codebook entry of a part is sought in the coarse grid cell that holds it. For a cell, entries whose least
distance to the cell's box is above some other entry's greatest distance can be nearest to no point of it; the others
are remembered under the cell, and only these are evaluated, exactly, for the parts that fall into it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, unused

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x is the whole number floor(SCALE * x).
SCALE = 256
#: Side of a grid cell, and cells that a task remembers per part before it starts afresh.
SIDE = 16
CELLS = 1 << 15
#: Parts whose distances are evaluated at once, and cells that are opened at once.
AT_ONCE = 1 << 14
OPENED = 1 << 11
#: Whole numbers must stay below this, so that squared distances and sums are exact in 64 bits.
LARGEST = 1 << 28


class CellMemo:
    """The cells of one part position met so far: cell -> row of ``near``, which marks the entries not dominated there."""

    def __init__(self, entries: np.ndarray, side: int = SIDE, limit: int = CELLS):
        self.entries, self.side, self.limit = entries, side, limit
        self.evaluated = self.opened = 0
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.near = np.zeros((0, len(self.entries)), bool)

    def _open(self, cells: np.ndarray) -> np.ndarray:
        """Per cell, the entries whose least distance to the box is not above the least of all greatest distances."""
        out = []
        for c in (cells[i : i + OPENED] for i in range(0, len(cells), OPENED)):
            low = (c * self.side)[:, None, :]
            below, above = low - self.entries, self.entries - (low + self.side - 1)
            least = (np.maximum(0, np.maximum(below, above)) ** 2).sum(2)
            most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
            out.append(least <= most.min(1, keepdims=True))
        self.opened += len(cells)
        return np.concatenate(out)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``; of entries equally near the first."""
        cells = np.floor_divide(x, self.side)
        view = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, of = np.unique(view, return_index=True, return_inverse=True)
        if len(self.rows) + len(first) > self.limit:
            self._clear()
        names = [view[i].tobytes() for i in first]
        new = [i for i, name in enumerate(names) if name not in self.rows]
        if new:
            self.rows.update((names[i], len(self.near) + k) for k, i in enumerate(new))
            self.near = np.concatenate([self.near, self._open(cells[first[new]])])
        row = np.fromiter((self.rows[name] for name in names), np.int64, len(names))[of]
        at, entry = np.nonzero(self.near[row])
        apart = ((x[at] - self.entries[entry]) ** 2).sum(1)
        self.evaluated += len(at)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        least = np.minimum.reduceat(apart, starts)
        hit = np.flatnonzero(apart == np.repeat(least, np.diff(np.r_[starts, len(at)])))
        return entry[hit[np.searchsorted(hit, starts)]], least


def _parts(vectors: pa.Array, dims: int, parts: int) -> np.ndarray:
    """(row, part, position) whole numbers of a batch of checked vectors."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), parts, dims // parts)
    whole = np.floor(x * SCALE)
    if np.abs(whole).max(initial=0) >= LARGEST:
        raise ValueError(f"components from {LARGEST / SCALE:.0f} on are too large for exact codes")
    return whole.astype(np.int64)


def _assigned(x: np.ndarray, memos: list[CellMemo]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances) of the parts of a batch, rows by parts."""
    entry, apart = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for p, memo in enumerate(memos):
        for i in range(0, len(x), AT_ONCE):
            entry[i : i + AT_ONCE, p], apart[i : i + AT_ONCE, p] = memo.nearest(x[i : i + AT_ONCE, p])
    return entry, apart


def usable(vectors: DataFrame, id_col: str, vec_col: str, parts: int) -> tuple[DataFrame, int]:
    """Rows whose vector has no null or non-finite component and the common length; and that length, 0 without rows.

    The common length is that of the smallest id's vector among lengths that are multiples of ``parts``.
    """
    v = F.col("vec")
    x = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *[F.col(c) for c in vectors.columns if c not in (id_col, vec_col)]).where(v.isNotNull() & ~F.exists(v, x) & (F.size(v) > 0) & (F.size(v) % parts == 0))
    first = sound.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec")).first()
    return (sound.where(F.size("vec") == first[0]), first[0]) if first else (sound, 0)


def train(sound: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of whole numbers, from ``usable`` rows.

    They start as the parts of the ``entries`` smallest ids (fewer rows: as many; rows that repeat an id go by vector).
    Every round sums the parts of each entry inside the tasks; a row per task, part and entry is shuffled, and one per
    part and entry reaches the driver, however many vectors there are.
    """
    first = sound.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("id", "vec").toArrow()
    books = _parts(first.column("vec"), dims, parts).transpose(1, 0, 2)
    k, width = books.shape[1], books.shape[2]
    sums = ", ".join(f"s{i} long" for i in range(width))
    for _ in range(rounds):
        now = books

        def run(batches, now=now):
            memos = [CellMemo(b) for b in now]
            total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
            for b in batches:
                x = _parts(b.column(0), dims, parts)
                slot = (_assigned(x, memos)[0] + k * np.arange(parts)).ravel()
                count += np.bincount(slot, minlength=parts * k)
                order = np.argsort(slot, kind="stable")
                heads = np.flatnonzero(np.r_[True, slot[order][1:] != slot[order][:-1]]) if len(slot) else slot
                if len(heads):
                    total[slot[order][heads]] += np.add.reduceat(x.reshape(-1, width)[order], heads)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(width))], names=["slot", "n", *(f"s{i}" for i in range(width))])

        each = sound.select("vec").mapInArrow(run, f"slot long, n long, {sums}")
        got = each.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).toArrow()
        slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
        means = np.floor_divide(np.stack([got.column(f"s{i}").to_numpy() for i in range(width)], 1), n[:, None])
        flat = now.reshape(parts * k, width).copy()
        flat[slot] = means
        books = flat.reshape(parts, k, width)
    return books


def encode(sound: DataFrame, books: np.ndarray, code: str = "code", error: str = "error") -> DataFrame:
    """``sound`` (id, vec, ..) without the vector, with its code (two hex digits a part) and squared error."""
    parts, dims = books.shape[0], books.shape[0] * books.shape[2]
    names = [c for c in sound.columns if c != "vec"]
    plain = sound.select("vec", *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    rest = plain.drop("vec").schema
    columns = [*rest.fieldNames(), "code_", "error_"]

    def run(batches):
        memos = [CellMemo(b) for b in books]
        for b in batches:
            entry, apart = _assigned(_parts(b.column(0), dims, parts), memos)
            codes = [bytes(r).hex() for r in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(codes, pa.string()), pa.array(apart.sum(1), pa.int64())], names=columns)

    return plain.mapInArrow(run, rest.add("code_", "string").add("error_", "long")).toDF(*names, code, error)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) per usable vector.

    Vectors that are null or empty or hold null or non-finite components are dropped, and those whose length is no
    multiple of ``parts`` or not that of the smallest id's vector. Components of 2**20 and more are refused. A null id
    sorts last; rows that repeat an id are vectors of their own; null labels are one label; equal distances go to the
    first entry; an empty table gives no rows; other columns are not read. The vectors are read once per round and once
    for the codes; labels are summed before they are shuffled.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte a part")
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    sound, dims = usable(given, "id", "embedding", parts)
    if not dims:
        empty = sound.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty.limit(0)
    books = train(sound, dims, parts, entries, rounds)
    coded = kept(encode(sound, books), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", unused(coded, "of"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
