"""Quality rules from the repeats inside a document, found with a suffix array of its words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITESPACE, append_columns

SYMBOLS = b"#*$%&|<>"
#: Words of documents that are sorted together; longer documents are sorted alone and whole.
PACK = 150_000
#: A repeat counts from so many words on.
MIN_REPEAT = 8
MAX_COVERED = 0.30
MAX_REPEAT = 150
MIN_WORDS = 50


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of a sequence, by prefix doubling, and the ranks of each step.

    After step k, suffixes have equal rank when their first 2**k symbols are equal. Only suffixes that still share
    their rank are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.r_[True, s[1:] != s[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else 0
    ranks, h = [rank.astype(np.int32)], 1
    single = first & np.r_[first[1:], True] if n else first
    active = order[~single]  # in suffix order, classes next to each other
    while len(active):
        nxt = active + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        own = rank[active]
        by = np.argsort(own * (n + 1) + second, kind="stable")
        active, own, second = active[by], own[by], second[by]
        start = np.r_[True, own[1:] != own[:-1]]
        new = start | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(active))
        rank = rank.copy()
        rank[active] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))
        ranks.append(rank.astype(np.int32))
        active = active[~(new & np.r_[new[1:], True])]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, ranks


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """Per position the length of the longest repeated substring that starts there.

    It is the depth of the innermost longest-common-prefix interval around the suffix: the larger of the common
    prefixes with its two neighbours in the suffix array.
    """
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    sa, ranks = suffix_array(symbols)
    p, q = sa[:-1], sa[1:]
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(ranks[0][p] == ranks[0][q])
    for k in range(len(ranks) - 1, -1, -1):
        a, b = p[live] + lcp[live], q[live] + lcp[live]
        inside = (a < n) & (b < n)
        same = np.zeros(len(live), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        lcp[live[same]] += 1 << k
    best[p] = lcp
    best[q] = np.maximum(best[q], lcp)
    return best


def _profile(symbols: np.ndarray, cuts: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words in repeated 3-word windows, words under maximal repeats, and the longest repeat.

    Documents have disjoint symbols, so that no repeat reaches from one into another.
    """
    n = len(symbols)
    at, best = np.arange(n), longest_repeats(symbols)
    add = lambda x: np.add.reduceat(np.r_[x.astype(np.int64), 0], cuts)
    windows = np.maximum.accumulate(np.where(best >= 3, at + 3, 0)) > at
    spans = np.maximum.accumulate(np.where(best >= min_repeat, at + best, 0)) > at
    return add(windows), add(spans), np.maximum.reduceat(np.r_[best, 0], cuts)


def repetition_columns(df: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``df`` with the counts of each whole text; null and empty texts have zero in all.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; covered_words: words under the union of all repeated
    substrings of ``min_repeat`` words or more (overlapping ones included); longest_repeat: words of the longest.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def factory():
        def compute(texts):
            out = np.zeros((len(names), len(texts)), np.int64)
            symbols: list[int] = []
            docs: list[int] = []
            cuts: list[int] = []

            def sort_pack():
                if docs:
                    out[4:, docs] = _profile(np.array(symbols, np.int64), np.array(cuts), min_repeat)
                    symbols.clear(), docs.clear(), cuts.clear()

            base = 0
            for i, t in enumerate(texts):
                words = t.split()
                lines = [x for x in t.split(b"\n") if x.strip(WHITESPACE)]
                out[:4, i] = len(words), len(t.translate(None, WHITESPACE).decode("utf-8", "replace")), len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines))
                if len(words) < 2:
                    continue
                if len(symbols) + len(words) > PACK:
                    sort_pack()
                    base = 0
                ids: dict[bytes, int] = {}
                known = ids.setdefault
                docs.append(i)
                cuts.append(len(symbols))
                symbols += [base + known(w, len(ids)) for w in words]
                base += len(ids)
            sort_pack()
            return list(out)

        return compute

    return append_columns(df, text_col, [T.StructField(n, T.LongType()) for n in names], factory)


def judge(df: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``df`` with the counts of :func:`repetition_columns` and the verdicts base_failed and kept.

    base_failed: under 50 words, or more than half the words in repeated 3-word windows. kept: not base_failed, the
    covered share is at most ``max_covered`` and the longest repeat at most ``max_repeat`` words. Texts that are null
    or empty fail the base rules.
    """
    out = repetition_columns(df, text_col, min_repeat)
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat))
