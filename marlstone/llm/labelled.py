"""Bounded samples of labelled documents, and the calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Labels (three numbers each) that are broadcast to the texts.
BROADCAST_LABELS = 1_000_000


def id_remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def known_labels(labels: DataFrame, label_col: str, modulus: int, held_out: int, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """(id, label, h, fold) of every id that may be learnt from: not held out, with a label.

    An id labelled more than once has the label of the majority (1 on a tie); null labels and ids are left out. ``h``
    is a hash of the id, which also deals the ids to two folds.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    known = known.where(id_remainder("id", modulus) != held_out).groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    return known.withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("fold", F.pmod(F.xxhash64("h"), F.lit(2)).cast("int"))


def training_documents(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_LABELS) -> DataFrame:
    """(text, label, fold) of all documents whose label may be learnt from, however many.

    The labels are written first and counted: at most ``most`` of them are broadcast, more are joined with the texts
    by a shuffle of both.
    """
    known = kept(known_labels(labels, label_col, modulus, held_out, id_col).select("id", "label", "fold"), "labels")
    known = F.broadcast(known) if known.count() <= most else known
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(id_remainder("id", modulus) != held_out)
    return texts.join(known, "id").select("text", "label", "fold")


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, text, label, fold) of at most ``per_class`` documents of each label, the same at every run.

    Documents are chosen by a hash of their id, which also deals them to two folds. The ids chosen are the bound of what is broadcast; texts stay on the executors, in the shared folder.
    """
    known = known_labels(labels, label_col, modulus, held_out, id_col, seed)
    chosen = [known.where(F.col("label") == c).orderBy("h", "id").limit(per_class) for c in (0, 1)]
    chosen = kept(chosen[0].unionByName(chosen[1]).select("id", "label", "fold"), "chosen")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label", "fold"), "sample")


class Logistic:
    """A calibration of a few features to a probability: ridge logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.02):
        y = y.astype(np.float64)
        self.mean, self.sd = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        share = min(max(prior, 1e-3), 1 - 1e-3)
        self.w = np.r_[np.zeros(x.shape[1]), np.log(share / (1 - share))]
        if len(x) < 8 or not 0 < y.sum() < len(y):
            return
        # Classes are sampled apart: weights bring them back to their share.
        c = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        z = self._z(x)
        pull = np.r_[np.full(x.shape[1], ridge * len(y) ** 0.5), 1e-6]
        for _ in range(60):
            p = self._p(z)
            step = np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (c * (p - y)) + pull * np.r_[self.w[:-1], 0])
            self.w = self.w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break

    def _z(self, x):
        return np.c_[np.clip((x - self.mean) / self.sd, -8, 8), np.ones(len(x))]

    def _p(self, z):
        return 1 / (1 + np.exp(-np.clip(z @ self.w, -40, 40)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._p(self._z(np.asarray(x, np.float64).reshape(-1, len(self.mean))))


def class_share(labels: DataFrame, label_col: str, modulus: int, held_out: int, id_col: str = "doc_id") -> float:
    """The share of label 1 among all labels that may be learnt from; one half if there is none."""
    got = labels.where(F.col(label_col).isNotNull() & (id_remainder(id_col, modulus) != held_out)).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    return 0.5 if got is None else float(got)
