"""Byte-level BPE encoding and decoding with a contiguous array of adjacent ranks per word."""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

NO_RANK = 1 << 30
#: Above so many symbols a word is merged with a queue of ranks: scanning for the minimum is quadratic in its length.
SHORT = 160
#: Words whose ids a worker remembers, in each of two generations; the young one may pass it by one pack of texts.
REMEMBERED = 40_000
#: Characters of text that are cut into words before the new ones among these are encoded together.
AHEAD = 1_000_000

# The word pattern of byte-level BPE vocabularies, with the white space of Unicode written out.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible Latin-1, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in visible else spare))
        spare += b not in visible
    return out


@dataclass
class Vocabulary:
    """byte_id: id per byte. rank, made: per pair of ids (left << 32 | right) its rank, and per rank the id it makes.

    token: bytes per id. special: strings that are one id wherever they stand.
    """

    byte_id: list[int]
    rank: dict[int, int]
    made: list[int]
    token: list[bytes]
    special: dict[str, int] = field(default_factory=dict)
    key: int = 0

    def __post_init__(self):
        pairs = np.array(list(self.rank), np.int64).reshape(-1)
        order = np.argsort(pairs)
        self._pairs = np.r_[pairs[order], np.iinfo(np.int64).max]
        self._ranks = np.r_[np.array(list(self.rank.values()), np.int64)[order], NO_RANK]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.searchsorted(self._pairs, pair)
        return np.where(self._pairs[at] == pair, self._ranks[at], NO_RANK)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A tokenizer file whose settings are those that this module works by; others are refused, not encoded wrongly."""
        with open(path, "rb") as f:
            raw = f.read()
        spec = json.loads(raw)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and (spec.get("decoder") or {}).get("type") == "ByteLevel"
        added = not any(a.get(k) for a in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (plain and level and added):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        ids, symbols = spec["model"]["vocab"], byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        special = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        token = [b""] * (1 + max([*ids.values(), *special.values()]))
        for s, i in ids.items():
            token[i] = bytes(byte_of[c] for c in s)
        for s, i in special.items():
            token[i] = s.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        return cls([ids[s] for s in symbols], {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(pairs)}, [ids[a + b] for a, b in pairs], token, special, zlib.crc32(raw))


def encode_word(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one word. ``parts[i]`` starts at boundary i; ``ranks[i]`` is that of the pair (i, i + 1)."""
    parts = [v.byte_id[b] for b in word]
    if len(parts) > SHORT:
        return _encode_long(parts, v)
    rank, made = v.rank.get, v.made
    ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == NO_RANK:
            break
        i = ranks.index(least)
        parts[i] = made[least]
        del parts[i + 1], ranks[i]  # the boundary between the two goes
        if i < len(ranks):
            ranks[i] = rank(parts[i] << 32 | parts[i + 1], NO_RANK)
        if i:
            ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NO_RANK)
    return parts


def _encode_long(parts: list[int], v: Vocabulary) -> list[int]:
    """The same merges in the same order, from a queue of (rank, place)."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, made = v.rank.get, v.made
    queue = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1], NO_RANK)) < NO_RANK]
    heapq.heapify(queue)
    while queue:
        r, i = heapq.heappop(queue)
        j = after[i]
        if parts[i] < 0 or j >= n or rank(parts[i] << 32 | parts[j]) != r:
            continue
        parts[i], parts[j] = made[r], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (s := rank(parts[a] << 32 | parts[b], NO_RANK)) < NO_RANK:
                heapq.heappush(queue, (s, a))
    return [p for p in parts if p >= 0]


def encode_words(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Packed ids of many short words at once: words of one length are the rows of a matrix of parts.

    Each row is a contiguous array of boundaries with the ranks of its adjacent parts. A round finds every row's
    least rank, deletes the boundary there and looks up the two neighbouring ranks anew; rows without a rank are done.
    """
    out: list[bytes] = [b""] * len(words)
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    byte_id, made = np.array(v.byte_id, np.int64), np.array(v.made, np.int64)
    for size, at in by_size.items():
        if size > SHORT:
            for i in at:
                out[i] = np.array(encode_word(words[i], v), "<u4").tobytes()
            continue
        for lo in range(0, len(at), step := max(1, 400_000 // size)):
            rows = np.array(at[lo : lo + step])
            parts = byte_id[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)].reshape(-1, size)
            ranks = v.ranks_of(parts[:, :-1], parts[:, 1:])
            while len(rows):
                least = ranks.min(axis=1) if ranks.shape[1] else np.full(len(rows), NO_RANK)
                done = least == NO_RANK
                if done.any():
                    for i, ids in zip(rows[done].tolist(), parts[done].astype("<u4")):
                        out[i] = ids.tobytes()
                    rows, parts, ranks, least = rows[~done], parts[~done], ranks[~done], least[~done]
                    if not len(rows):
                        break
                n, k = parts.shape
                each, i = np.arange(n), ranks.argmin(axis=1)
                parts[each, i] = made[least]
                keep = np.ones((n, k), bool)
                keep[each, i + 1] = False
                parts = parts[keep].reshape(n, k - 1)
                keep = np.ones((n, k - 1), bool)
                keep[each, i] = False
                ranks = ranks[keep].reshape(n, k - 2)
                r = np.flatnonzero(i < k - 2)
                ranks[r, i[r]] = v.ranks_of(parts[r, i[r]], parts[r, i[r] + 1])
                r = np.flatnonzero(i > 0)
                ranks[r, i[r] - 1] = v.ranks_of(parts[r, i[r] - 1], parts[r, i[r]])
    return out


class Codec:
    """Encodes whole texts to packed little-endian 32-bit ids and back."""

    def __init__(self, v: Vocabulary):
        import regex

        self.v = v
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Put the ids of all ``words`` into the young generation; a full one takes the place of the old."""
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        fresh = []
        for w in words.difference(self.young):
            got = self.old.get(w)
            if got is None:
                fresh.append(w)
            else:
                self.young[w] = got
        self.young.update(zip(fresh, encode_words([w.encode() for w in fresh], self.v)))

    def encode_all(self, texts: list[str]):
        """The packed ids of each text, in order; texts are read ahead in packs of about ``AHEAD`` characters."""
        pack: list[list] = []
        size = 0
        for t in texts:
            pack.append(self._pieces(t))
            size += len(t)
            if size >= AHEAD:
                yield from self._flush(pack)
                pack, size = [], 0
        yield from self._flush(pack)

    def _pieces(self, text: str) -> list:
        """Lists of words, and between them the packed ids of special strings."""
        if self.cut is None or not self.cut.search(text):
            return [self.words(text)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.words(text[at : m.start()]), np.array([self.v.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return [*out, self.words(text[at:])]

    def _flush(self, pack: list[list]):
        self._learn(set().union(*(p for pieces in pack for p in pieces if type(p) is list)))
        ids = self.young.__getitem__
        for pieces in pack:
            yield b"".join([b"".join(map(ids, p)) if type(p) is list else p for p in pieces])
        for w in [w for w in self.young if len(w) > SHORT]:
            del self.young[w]

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.v.token.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The codec of this Python worker for a broadcast vocabulary: it outlives the task, so that its memory is used again."""
    if shared.value.key not in _codecs:
        _codecs.clear()
        _codecs[shared.value.key] = Codec(shared.value)
    return _codecs[shared.value.key]


def _shared(df: DataFrame, vocabulary: str):
    """The vocabulary as a broadcast variable; its size is that of the file, not of the data."""
    return df.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as an array of int; null texts count as empty and have no ids."""
    shared = _shared(df, vocabulary)

    def factory():
        codec = _codec(shared)
        return lambda texts: [[np.frombuffer(p, "<i4") for p in codec.encode_all([t.decode("utf-8", "replace") for t in texts])]]

    return append_columns(df, text_col, [T.StructField(out, T.ArrayType(T.IntegerType()))], factory)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that an array of ids stands for; bytes that are no UTF-8 become U+FFFD, null gives ''."""
    from pyspark.sql import functions as F

    shared = _shared(df, vocabulary)

    @F.pandas_udf(T.StringType())
    def to_text(col):
        codec = _codec(shared)
        return col.map(lambda x: "" if x is None else codec.decode(np.asarray(x, "<u4").tobytes()))

    return df.withColumn(out, to_text(ids_col))


def round_trip(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded in one pass.

    Digests are lowercase hex: of the ids as little-endian unsigned 32-bit integers, and of the decoded text in UTF-8.
    Null and empty texts have no ids. Rows are independent: nothing is shuffled; repeated rows and null ids stay, an
    empty table gives no rows, and columns that bear the names of the results are replaced.
    """
    shared = _shared(df, vocabulary)

    def factory():
        codec = _codec(shared)

        def compute(texts):
            n, ids, back = [], [], []
            for packed in codec.encode_all(t.decode("utf-8", "replace") for t in texts):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(codec.decode(packed).encode()).hexdigest())
            return n, ids, back

        return compute

    return append_columns(df, text_col, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], factory)
