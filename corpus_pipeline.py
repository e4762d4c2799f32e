"""The corpus pipeline: quality, toxicity, near-duplicates, the mix of sources, and the token digests of what is left.

Each stage takes the documents that its predecessor kept, and all but the last return their columns as they are. For
every stage: null and empty texts are texts without words; texts may be of any length; rows with a null id have no
labels and stay rows; repeated rows are judged alike; an empty table gives an empty table; further columns, whatever
their names, are carried along. ``run`` writes every stage's result as Parquet in the shared folder of the session and
reads it again for the next, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, mixing, quality, simhash, toxicity
from marlstone.llm.common import kept, quoted, read, unused
from marlstone.llm.queries import tokenizer_path


def _judged(docs: DataFrame, scored: DataFrame, keep) -> DataFrame:
    return scored.where(keep).select(*[quoted(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on these documents' labels, does not reject.

    A text without words scores by the calibration like any other; without labels of both classes all stay or go together.
    """
    model, out = quality.train(docs, read(spark, sf_dir, "labels")), unused(docs, "quality")
    return _judged(docs, quality.score(docs, model, out=out), F.col(out) >= quality.THRESHOLD)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by a model trained on these documents' labels; texts without words as quality."""
    model, out = toxicity.train(docs, read(spark, sf_dir, "labels")), unused(docs, "toxicity")
    return _judged(docs, toxicity.score(docs, model, out=out), F.col(out) < toxicity.THRESHOLD)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the first by id, then by a hash of the row.

    Texts without words are one group; wholly equal rows give one; rows without an id come last in their group.
    """
    return simhash.one_per_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes: a row per document and pass over it; texts without words give none."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of the mixed documents, a row for each."""
    return bpe.round_trip(docs.select("doc_id", "text"), tokenizer_path()).drop("text")


STAGES = [("quality_classifier", quality_stage), ("toxicity", toxicity_stage), ("simhash_near_dedup", simhash_stage), ("mixing_sources", mixing_stage), ("bpe_encoding_and_decoding", bpe_stage)]

#: Trained scores, XXH64 fingerprints and seeded draws have no DuckDB form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
