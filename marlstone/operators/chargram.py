"""Similarity of short texts by TF-IDF of the character n-grams of their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.text import char_ngrams, counted
from ..sources.stages import kept
from .dense import BLOCK, GATHERED, _spread, location_blocks

#: How many times as many items as queries a block of a location holds.
WIDE = 16


def grams(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram, tf); ids are distinct, so that grams are counted inside the row and nothing is shuffled."""
    return df.select(id_col, F.explode(counted(char_ngrams(text_col))).alias("o")).select(id_col, F.col("o.term").alias("gram"), F.col("o.tf").alias("tf"))


def fit(corpus: DataFrame, id_col: str, text_col: str, min_df: int = 2) -> DataFrame:
    """(gram, df, idf) of the grams in at least ``min_df`` texts. Equal texts are taken apart once and count as often as they occur."""
    n = corpus.agg(F.count("*").cast("double").alias("n"))
    texts = corpus.groupBy(text_col).agg(F.count("*").alias("times"))
    df = grams(texts, "times", text_col).groupBy("gram").agg(F.sum("times").alias("df")).where(F.col("df") >= min_df)
    return df.join(F.broadcast(n)).select("gram", "df", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def vectors(df: DataFrame, model: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram, w): (1 + ln tf) idf, scaled to length 1 per text; grams that the model lacks are dropped.

    A text's length is summed over its own rows: no table of all texts is joined, which the driver might broadcast.
    """
    w = grams(df, id_col, text_col).join(model, "gram").select(id_col, "gram", ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "gram", (F.col("w") / norm).alias("w"))


def similarity(pairs: DataFrame, query_vectors: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """(qid, row_id, char_t) of the given pairs; 0 where no gram is shared.

    Each text's grams are one map, joined by its id, so that a pair stays one row.
    """
    packed = lambda v, key, name: v.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias(name))
    p = pairs.select("qid", "row_id").join(packed(query_vectors, "qid", "q"), "qid", "left").join(packed(item_vectors, "row_id", "i"), "row_id", "left")
    total = F.aggregate(F.map_keys("q"), F.lit(0.0), lambda s, g: s + F.element_at("q", g) * F.coalesce(F.try_element_at(F.col("i"), g), F.lit(0.0)))
    return p.select("qid", "row_id", F.coalesce(total, F.lit(0.0)).alias("char_t"))


def text_vectors(texts: DataFrame, model: DataFrame, text_col: str) -> DataFrame:
    """(text, grams, weights): :func:`vectors` of the distinct texts, as numbers of grams in order; ``model`` numbers them by ``id``."""
    v = vectors(texts.select(text_col).distinct(), model, text_col, text_col).join(model.select("gram", "id"), "gram")
    packed = v.groupBy(F.col(text_col).alias("text")).agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("v"))
    return packed.select("text", F.col("v.id").alias("grams"), F.col("v.w").alias("weights"))


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values) of a column of arrays, null ones being empty."""
    sizes = pc.fill_null(pc.list_value_length(table[column]), 0).to_numpy()
    return sizes, pc.list_flatten(table[column]).to_numpy()


def location_similarity(queries: DataFrame, items: DataFrame, model: DataFrame, digits: int = 5, block: int = BLOCK // 4) -> DataFrame:
    """(qid, row_id, char_t) of every query and every item of its location, at ``digits`` digits; 0 where no gram is shared.

    queries: qid, loc, text; items: row_id, loc, text; model: as of :func:`fit`. These are as many pairs as the locations'
    sizes multiply to: none is shuffled, joined or gathered. Blocks of a location's queries meet blocks of its items, with
    the vectors of their distinct texts; a task scores each pair of texts once and gives its pairs of rows in batches.
    """
    model = kept(model.withColumn("id", F.monotonically_increasing_id()), "grams")
    sizes = kept(location_blocks(queries, items, block, WIDE), "blocks")
    # What is shuffled is small against the pairs made of it: Spark is not to join partitions.
    tasks = 2 * max(queries.sparkSession.sparkContext.defaultParallelism, sizes.agg(F.sum(F.col("nq") * F.col("ni"))).first()[0] or 0)
    blocks = F.broadcast(sizes)
    q = queries.join(blocks, "loc").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int")).groupBy("loc", "qb", "ni", "text").agg(F.collect_list("qid").alias("qids"))
    i = items.join(blocks, "loc").withColumn("ib", F.pmod(F.xxhash64("row_id"), F.col("ni")).cast("int")).groupBy("loc", "ib", "nq", "text").agg(F.collect_list("row_id").alias("row_ids"))
    none = lambda like, name: F.lit(None).cast(like.schema[name].dataType).alias(name)
    a = q.join(text_vectors(queries, model, "text"), "text", "left").select("loc", "qb", _spread(F.col("ni")).alias("ib"), "qids", none(i, "row_ids"), "grams", "weights")
    b = i.join(text_vectors(items, model, "text"), "text", "left").select("loc", _spread(F.col("nq")).alias("qb"), "ib", none(q, "qids"), "row_ids", "grams", "weights")
    out = T.StructType([queries.schema["qid"], items.schema["row_id"], T.StructField("char_t", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        asked = pc.is_valid(both["qids"])
        a, b = both.filter(asked), both.filter(pc.invert(asked))
        if not len(a) or not len(b):
            return
        sizes, gram = _lists(b, "grams")
        by = np.argsort(gram, kind="stable")
        gram, weight, text = gram[by], _lists(b, "weights")[1][by], np.repeat(np.arange(len(b)), sizes)[by]
        sizes, row = _lists(b, "row_ids")
        text_of = np.repeat(np.arange(len(b)), sizes)
        for qids, grams, weights in zip(a["qids"].combine_chunks(), a["grams"].to_pylist(), a["weights"].to_pylist()):
            lo, hi = np.searchsorted(gram, grams or []), np.searchsorted(gram, grams or [], "right")
            at = np.concatenate([np.arange(0), *map(np.arange, lo, hi)])
            sims = np.bincount(text[at], weight[at] * np.repeat(weights or [], hi - lo), len(b))
            sims = (np.floor(sims * 10.0**digits + 0.5) / 10.0**digits)[text_of]
            most = max(1, GATHERED // len(row))
            for k in range(0, len(qids.values), most):
                some = qids.values[k : k + most]
                of = pa.array(np.repeat(np.arange(len(some), dtype=np.int32), len(row)))
                yield pa.RecordBatch.from_arrays([some.take(of).cast(arrow[0].type), pa.array(np.tile(row, len(some)), arrow[1].type), pa.array(np.tile(sims, len(some)))], schema=arrow)

    return a.unionByName(b).repartition(tasks, "loc", "qb", "ib").groupBy("loc", "qb", "ib").applyInArrow(score, out)
