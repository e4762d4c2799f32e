"""A quality classifier by compression with dictionaries of good and of bad text."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, release
from .labelled import Logistic, class_share, id_remainder, training_sample

#: Labelled documents of each class that are learnt from.
PER_CLASS = 6000
#: Bytes of a class's documents from which dictionaries are made, on the driver.
LEARN_BYTES = 32 << 20
#: A text is compressed in pieces of so many bytes, all of them: a dictionary helps little beyond the first few KB.
PIECE = 2048
#: Bytes of a dictionary.
DICTIONARY = 800_000
LEVEL = 3
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0
N_FEATURES = 4


def cut(text: bytes) -> list[bytes]:
    """The whole text in pieces; what would be less than half a piece at the end stays with the one before."""
    n = max(1, (len(text) + PIECE // 2) // PIECE)
    return [text[i * PIECE : (i + 1) * PIECE if i < n - 1 else None] for i in range(n)] if text else []


class Compressors:
    """Sizes of texts under a dictionary of good text, one of bad text, and none."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.ready = good, bad, None

    def __getstate__(self):
        return self.good, self.bad

    def __setstate__(self, state):
        self.__init__(*state)

    def _open(self):
        import zstandard as zstd

        def compressor(raw):
            if not raw:
                return zstd.ZstdCompressor(level=LEVEL)
            d = zstd.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.ready = [compressor(x).compress for x in (self.good, self.bad, b"")]
        return self.ready

    def features(self, text: bytes) -> tuple[float, ...]:
        """Normalised differences of the compressed sizes: over the whole text, of its worst and its best piece; ratio.

        Each is (size with the good dictionary - size with the bad one) / (their sum); the ratio is the size with the
        better of the two over the raw size. A text without words has zeros.
        """
        by = self.ready or self._open()
        pieces = cut(text)
        if not pieces:
            return (0.0,) * N_FEATURES
        good, bad = (np.array([len(by[k](p)) for p in pieces], np.float64) for k in (0, 1))
        raw = np.array([len(p) for p in pieces], np.float64)
        diff = (good - bad) / (good + bad)
        return float((good - bad).sum() / (good + bad).sum()), float(diff.max()), float(diff.min()), float(np.minimum(good, bad).sum() / raw.sum())


class QualityModel:
    def __init__(self, compressors: Compressors, calibration: Logistic):
        self.compressors, self.calibration = compressors, calibration

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.calibration(np.array([self.compressors.features(t) for t in texts]).reshape(len(texts), N_FEATURES))


def _pieces(sample: DataFrame, most: int) -> DataFrame:
    """(label, fold, piece, at): all pieces of documents of about ``most`` bytes a class, ``at`` giving the order of a hash.

    Documents are drawn whole, by a hash of their id, until they reach ``most``; one that alone has over a sixteenth of
    it is not drawn. The sample's number of rows bounds the window.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    before = F.sum("size").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    drawn = sample.withColumn("size", size).where(F.col("size") <= most // 16).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)

    def to_pieces(batches):
        for b in batches:
            got = {"doc_id": [], "label": [], "fold": [], "n": [], "piece": []}
            for i, y, f, t in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("fold").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                for n, p in enumerate(cut(t or b"")):
                    for k, v in zip(got, (i, y, f, n, p)):
                        got[k].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(got.items(), kinds)})

    cuts = drawn.mapInArrow(to_pieces, "doc_id long, label int, fold int, n long, piece binary")
    return cuts.select("label", "fold", "piece", F.xxhash64("doc_id", "n").alias("at"))


def _dictionary(rows: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes and an eighth of the text; too little text to train on serves as it is."""
    import zstandard as zstd

    with contextlib.suppress(zstd.ZstdError):
        if len(rows) >= 8:
            return zstd.train_dictionary(min(size, max(1024, sum(map(len, rows)) // 8)), rows).as_bytes()
    return b"".join(rows)[:size]


def _compressors(sample: DataFrame, size: int, most: int) -> list[Compressors]:
    """Dictionaries from the pieces of fold 0, of fold 1, and of both.

    The trainer is a library call on one machine: ``most`` bounds the bytes of a class that reach it.
    """
    pieces, by = _pieces(sample, most), []
    for c in (1, 0):
        rows = pieces.where(F.col("label") == c).toArrow().sort_by([("at", "ascending"), ("piece", "ascending")])
        piece, fold = rows.column("piece").to_pylist(), rows.column("fold").to_pylist()
        del rows
        by.append([_dictionary([p for p, f in zip(piece, fold) if f in folds], size) for folds in ((0,), (1,), (0, 1))])
        del piece
        release()  # the driver's Python outlives the training
    return [Compressors(good, bad) for good, bad in zip(*by)]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, size: int = DICTIONARY, most: int = LEARN_BYTES) -> QualityModel:
    """Dictionaries and calibration from a sample that the parameters bound.

    Each half of the sample is judged by the dictionaries of the other, which gives the calibration; texts are then
    scored with dictionaries of both halves. Without labels of both classes every score is the share of good labels
    (one half without any).
    """
    share = class_share(labels, "quality", MODULUS, HELD_OUT)
    sample = training_sample(docs, labels, "quality", MODULUS, HELD_OUT, per_class)
    *halves, whole = _compressors(sample, size, most)
    shared = sample.sparkSession.sparkContext.broadcast(halves)

    def judge(batches):
        for b in batches:
            rows = zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("fold").to_pylist())
            x = np.array([shared.value[1 - fold].features(t or b"") for t, fold in rows], np.float64).reshape(b.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *(pa.array(x[:, k]) for k in range(N_FEATURES))], names=["doc_id", "label", *"abcd"])
        release()

    got = sample.mapInArrow(judge, "doc_id long, label int, a double, b double, c double, d double").toArrow().sort_by([("doc_id", "ascending"), ("a", "ascending")])
    shared.destroy()
    x = np.stack([got.column(c).to_numpy() for c in "abcd"], axis=1)
    return QualityModel(whole, Logistic(x, got.column("label").to_numpy(), share))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1; null and empty texts score like a text without words.

    The model is two dictionaries of fixed size, so it is broadcast; rows are independent and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, text_col, [T.StructField(out, T.DoubleType())], lambda: lambda texts: [shared.value.score(texts)])


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; repeated rows have equal results.

    Null and empty texts score like a text without words; an empty table gives no rows; labels of ids that are not in
    ``docs`` teach nothing; a null id is not held out by a remainder and its ``held_out`` is null.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(d, train(d, labels))
    return scored.select("doc_id", (id_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
