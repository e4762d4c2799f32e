"""Fill-in-middle texts: cuts at unit boundaries, found by a learned index from boundary numbers to offsets.

The units of a text lie at irregular offsets. For each text the offsets of all unit boundaries are covered by straight
segments, each within ``BOUND`` bytes of every boundary it covers, and the byte-sized residuals are stored beside
them: any boundary is then predicted by its segment and corrected exactly by its residual, without the offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, quoted, unused, without

#: A segment's line is at most so many bytes away from each boundary that it covers; residuals fit in a byte.
BOUND = 100
#: Per cent of documents that stay plain, and of the rest that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Boundaries that a segment is tried on at first; doubled while all of them fit.
REACH = 256


def boundaries(text: bytes) -> np.ndarray:
    """Byte offsets at which units (runs of ASCII letters, or single characters) begin, and the text's end."""
    x = np.frombuffer(text, np.uint8)
    low = x | 32
    letter = (low >= 97) & (low <= 122)
    begins = (x & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(begins), len(x))


class RankIndex:
    """Boundary number -> byte offset: segments (first, base, slope) and a residual per boundary."""

    def __init__(self, offsets: np.ndarray, bound: int = BOUND):
        """Each segment starts at a boundary and reaches as far as some slope keeps all its boundaries within the bound."""
        first, slope, at, n = [], [], 0, len(offsets)
        while at < n:
            reach, low, high = min(REACH, n - at), -np.inf, np.inf
            while True:
                step = np.arange(1, reach, dtype=np.float64)
                rise = (offsets[at + 1 : at + reach] - offsets[at]).astype(np.float64)
                highs, lows = np.minimum.accumulate((rise + bound - 1) / step), np.maximum.accumulate((rise - bound + 1) / step)
                fits = int(np.searchsorted(lows > highs, True))
                if fits < len(step) or at + reach == n:
                    break
                reach = min(2 * reach, n - at)
            low, high = (lows[fits - 1], highs[fits - 1]) if fits else (0.0, 0.0)
            first.append(at)
            slope.append((low + high) / 2)
            at += fits + 1
        self.first, self.slope = np.array(first, np.int64), np.array(slope)
        self.base = offsets[self.first]
        self.residual = (offsets - self._predict(np.arange(n))).astype(np.int8)

    def _predict(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, rank, "right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.first[s])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        return self._predict(rank) + self.residual[rank]


def draws(id_col: Column, seed: str = SEED) -> Column:
    """The draws of an id: a SHA-256 whose groups of eight digits are numbers. A null id is written as nothing."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)


FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("segments", T.IntegerType()), T.StructField("output", T.StringType())]


def _characters(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _arrange(text: bytes, h: list[int], marks: tuple[bytes, bytes, bytes], plain: int, suffix_first: int, bound: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, segments, output) of one text by its four draws."""
    offsets = boundaries(text)
    n = len(offsets) - 1
    if not text or h[2] % 100 >= 100 - plain or any(m in text for m in marks):
        return n, "plain", None, None, 0, text
    index = RankIndex(offsets, bound)
    a, b = index.offset(np.sort(np.array([h[0] % (n + 1), h[1] % (n + 1)])))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    spm = h[3] % 100 < suffix_first
    output = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return n, "spm" if spm else "psm", _characters(prefix), _characters(middle), len(index.first), output


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, bound: int = BOUND) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars, segments (of the text's index) and output, the arranged text.

    A text is cut at two of its n + 1 unit boundaries, drawn by a hash of its id: prefix, middle and suffix, arranged
    with marks as prefix, suffix, middle (psm) or suffix, prefix, middle (spm). plain: texts that are empty (null
    included), contain a mark, or are drawn to stay; their output is the text and their lengths are null. A null id
    draws like any other, repeated rows draw alike, texts may be of any length (a task holds one slice of texts, or one
    text, at a time), an empty table gives none. Columns of ``docs`` named like a new one are replaced; others stay.
    No row moves between tasks.
    """
    if not 0 < bound <= 120:
        raise ValueError("residuals are stored in a byte: the bound is 120 at most")
    as_bytes = tuple(m.encode() for m in marks)
    if {id_col.lower(), text_col.lower()} & {f.name for f in FIELDS}:
        raise ValueError("the id and the text must not be named like a result")
    given = without(docs, [f.name for f in FIELDS])
    key = unused(given, "fim")
    # A text and its draws travel to the task in one column of bytes: 32 bytes of draws, then the text.
    head = F.substring(draws(F.col(quoted(id_col)), seed), 1, 32)
    packed = given.withColumn(key, F.concat(F.encode(head, "UTF-8"), F.encode(F.coalesce(F.col(quoted(text_col)), F.lit("")), "UTF-8")))

    def factory():
        def compute(rows: list[bytes]):
            got = [_arrange(r[32:], [int(r[8 * k : 8 * k + 8], 16) for k in range(4)], as_bytes, plain, suffix_first, bound) for r in rows]
            *columns, output = zip(*got) if got else ((),) * len(FIELDS)
            return [*columns, pa.array(output, pa.binary()).cast(pa.string())]

        return compute

    return without(append_columns(packed, key, FIELDS, factory), [key])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of the given form was made of: the first of each mark is the mark itself."""
    p, s, m = marks

    def unfold(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        at = F.instr(rest, second)
        tail = F.substr(rest, at + len(second))
        end = F.instr(tail, m)
        return F.substr(rest, F.lit(1), at - 1), F.substr(tail, F.lit(1), end - 1), F.substr(tail, end + len(m))

    prefix, suffix, middle = unfold(p, s)
    suffix2, prefix2, middle2 = unfold(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
