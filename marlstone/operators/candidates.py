"""Candidates from several sources, and the features of query-item pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions.numbering import numbered
from ..sources.stages import kept
from . import bm25 as B
from . import dense as D
from .location import log_prior
from .prepare import visible

BETA_BM25, BETA_DENSE = 2.0, 0.03
K_LOC, K_GLOBAL, K_HIST = 300, 50, 50
#: Source bits; model m has 3 + 2m with the location prior and 4 + 2m without.
BIT_BM25_LOC, BIT_BM25, BIT_HISTORY = 0, 1, 2


def top_k(df: DataFrame, score: str, k: int) -> DataFrame:
    """The best ``k`` rows per query with their rank from 1; only k rows per query and task are shuffled."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 6)), "row_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visible_pairs(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``pairs`` (qid, row_id, ..) that the query may see, with its search location s and the item's location l."""
    q = queries.select("qid", "fold", F.col("search_location_id").alias("s"))
    i = corpus.select("row_id", "in_bench", "folds", F.col("item_location_id").alias("l"))
    j = pairs.join(q, "qid").join(i, "row_id")
    return j.where(visible(F.col("fold"), F.col("in_bench"), F.col("folds"))).drop("fold", "in_bench", "folds")


def bm25_lists(terms: DataFrame, index: B.BlockIndex, queries: DataFrame, listed: DataFrame, chunks: DataFrame, trans: DataFrame, totals: DataFrame, k_loc: int = K_LOC, k_global: int = K_GLOBAL, beta: float = BETA_BM25) -> tuple[DataFrame, DataFrame]:
    """The top lists by BM25 with the location prior and without, over the visible rows of ``listed``.

    A row of the index stands in for itself and its copies (``base``), which have places of their own: rows are scored
    once and take their places afterwards. The bound of a chunk has the best prior of any place that the query may see.
    """
    q = queries.select("qid", "fold", F.col("search_location_id").alias("s"))
    own = listed.select(F.col("row_id").alias("placed"), F.col("base").alias("row_id"), "in_bench", "folds", F.col("item_location_id").alias("l"))
    at = own.join(chunks.select("row_id", "place", "chunk"), "row_id").select("place", "chunk", "l", "in_bench", F.explode_outer("folds").alias("see")).distinct()
    at = kept(at, "places")

    def prior(bounds: DataFrame) -> DataFrame:
        seen = bounds.join(q, "qid").join(at, ["place", "chunk"]).where(F.col("in_bench") | (F.col("fold") == F.col("see")))
        return log_prior(seen, trans, totals).groupBy("qid", "place", "chunk", "bound").agg((F.lit(beta) * F.max("lp")).alias("add"))

    def placed(scored: DataFrame) -> DataFrame:
        j = scored.drop("add", "place", "chunk").join(q, "qid").join(own, "row_id").where(visible(F.col("fold"), F.col("in_bench"), F.col("folds")))
        return j.drop("row_id", "fold", "in_bench", "folds").withColumnRenamed("placed", "row_id")

    with_prior = B.bm25_topk(terms, index, k_loc, prior, lambda df: log_prior(placed(df), trans, totals).withColumn("add", F.lit(beta) * F.col("lp")))[0]
    plain = B.bm25_topk(terms, index, k_global, None, lambda df: placed(df).withColumn("add", F.lit(0.0)))[0]
    return with_prior, plain


def _term_sums(b: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
    """For :func:`dense.block_topk`: per query and item the sum of the weights of the query's terms, -inf if it has none."""
    n, sizes = len(b), b["terms"].map(len).to_numpy()
    term, weight = (np.concatenate(b[c].to_numpy()) for c in ("terms", "weights"))
    by = np.argsort(term, kind="stable")
    term, weight, row = term[by], weight[by], np.repeat(np.arange(n), sizes)[by]

    def sums(part: pd.DataFrame) -> np.ndarray:
        out = np.empty((len(part), n))
        for k, asked in enumerate(part["terms"]):
            ends = zip(np.searchsorted(term, asked), np.searchsorted(term, asked, "right"))
            at = np.concatenate([np.arange(lo, hi) for lo, hi in ends])
            out[k] = np.bincount(row[at], weight[at], minlength=n)
        out[out <= 0] = -np.inf
        return out

    return sums


def bm25_block_lists(terms: DataFrame, postings: DataFrame, queries: DataFrame, places: DataFrame, trans: DataFrame, k_loc: int = K_LOC, k_global: int = K_GLOBAL, beta: float = BETA_BM25, block: int = D.BLOCK) -> tuple[DataFrame, DataFrame]:
    """:func:`bm25_lists` for short texts from few words, where bounds leave out few chunks: by blocks, as vectors are searched.

    A row is the numbers and combined weights of its terms that any query has; a task sums them for a block of queries
    against a block of rows, and no matching posting becomes a row. Rows and queries that are alike are scored once
    (:func:`dense.class_topk`). ``places``: as for :func:`dense.placed`.
    """
    ids = kept(numbered(terms.select("term").distinct(), ["term"], "id"), "ids")
    weight = sum((F.when(F.col("field") == f, F.lit(w)).otherwise(0.0) for f, w in B.COMBINE.items()), F.lit(0.0)) * F.col("w")
    each = postings.join(ids, "term").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("id", weight.alias("w")))).alias("t"))
    rows, members = D.classes(each.select("row_id", F.col("t.id").alias("terms"), F.col("t.w").alias("weights")), places, ["terms", "weights"], max(k_loc, k_global))
    asked = terms.join(ids, "term").groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("terms"))
    asked = kept(queries.select("qid", "fold", F.col("search_location_id").alias("loc")).join(asked, "qid"), "asked")
    best = lambda k, weight: D.class_topk(asked, rows, members, k, ["terms"], weight, trans, block=block, product=_term_sums, rounds=False)
    return best(k_loc, beta), best(k_global, 0.0)


def source_lists(bm25: tuple[DataFrame, DataFrame], history: DataFrame, dense: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(qid, row_id, bit, rank, score) of all sources.

    bm25: its top lists with the location prior and without; history: its top list; dense: the same two per model.
    """
    lists = [(BIT_BM25_LOC, bm25[0]), (BIT_BM25, bm25[1]), (BIT_HISTORY, history.withColumn("score", F.col("hist_knn")))]
    for m, (loc, plain) in enumerate(dense):
        lists += [(3 + 2 * m, loc), (4 + 2 * m, plain)]
    out = None
    for bit, df in lists:
        part = df.select("qid", "row_id", F.lit(bit).alias("bit"), F.col("rank").cast("long").alias("rank"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def union_candidates(lists: DataFrame) -> DataFrame:
    """(qid, row_id, src): each pair once, with the bits of its sources."""
    return lists.groupBy("qid", "row_id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("src"))


def source_flags(cands: DataFrame, n_sources: int) -> DataFrame:
    return cands.withColumns({f"src{k}": F.shiftright("src", k).bitwiseAND(1).cast("double") for k in range(n_sources)})


def label(cands: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``cands`` with label 1 where the item is relevant to the query; copies of items never are."""
    rel = queries.where("rel is not null").select("qid", F.explode("rel").alias("item_id"), F.lit(1).alias("hit"))
    own = corpus.where(F.col("src_row").isNull()) if "src_row" in corpus.columns else corpus
    hits = rel.join(own.select("item_id", "row_id"), "item_id").select("qid", "row_id", "hit").distinct()
    return cands.join(hits, ["qid", "row_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


def candidate_recall(labelled: DataFrame, queries: DataFrame) -> DataFrame:
    """(fold, recall): mean share of a query's relevant items among its candidates."""
    hits = labelled.groupBy("qid").agg(F.sum("label").cast("double").alias("hits"))
    q = queries.where("rel is not null").join(hits, "qid", "left")
    return q.groupBy("fold").agg(F.avg(F.coalesce("hits", F.lit(0.0)) / F.size("rel")).alias("recall"))


def best_scores(lists: DataFrame, names: dict[int, str]) -> DataFrame:
    """One row per query with the best score of the sources named, from their first ranks: no further pass."""
    return lists.where("rank = 1").groupBy("qid").agg(*[F.max(F.when(F.col("bit") == b, F.col("score"))).alias(n) for b, n in names.items()])


def relative_scores(df: DataFrame, models: list[str], beta: float = BETA_DENSE) -> DataFrame:
    """Scores against the best visible item: needs bm_comb, lp, q_bm_max and per model dense_, q_dn_max_, dnl_max_."""
    out = {"bm_rel": F.col("bm_comb") / F.greatest(F.coalesce("q_bm_max", F.lit(0.0)), F.lit(1e-6))}
    for m in models:
        out[f"dense_rel_{m}"] = F.col(f"dense_{m}") - F.col(f"q_dn_max_{m}")
        out[f"dense_loc_rel_{m}"] = F.col(f"dense_{m}") + F.lit(beta) * F.col("lp") - F.col(f"dnl_max_{m}")
    return mean_relative(df.withColumns(out), models)


def mean_relative(df: DataFrame, models: list[str]) -> DataFrame:
    return df.withColumn("dense_loc_rel_mean", sum((F.col(f"dense_loc_rel_{m}") for m in models), F.lit(0.0)) / F.lit(float(len(models))))


def query_features(queries: DataFrame, n_terms: DataFrame, totals: DataFrame, per_location: DataFrame, seen: DataFrame, best: DataFrame) -> DataFrame:
    """One row of features per query; locations without history have self share -1."""
    q = queries.select("qid", "fold", F.col("search_location_id").alias("s"), F.char_length("search_query").cast("double").alias("q_len"), (F.char_length("search_infm_params_text") > 0).cast("double").alias("q_has_params"))
    q = q.join(n_terms, "qid", "left").join(totals, "s", "left").join(per_location.withColumnRenamed("loc", "s"), "s", "left").join(seen, "qid", "left").join(best, "qid", "left")
    zero = F.lit(0.0)
    return q.withColumns({
        "q_nterms": F.coalesce(F.col("n_terms").cast("double"), zero),
        "q_loc_self": F.coalesce("self_share", F.lit(-1.0)),
        "q_loc_hist": F.log1p(F.coalesce(F.col("total").cast("double"), zero)),
        "q_loc_items": F.log1p(F.coalesce(F.col("n_items").cast("double"), zero)),
        "q_bm_max": F.coalesce("q_bm_max", zero),
    }).drop("n_terms", "self_share", "total", "n_items")


def rank_within(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with ranks from 0, the highest value first, ties by row; one partitioning by query serves all."""
    by = lambda c: Window.partitionBy("qid").orderBy(F.desc(F.round(c, 8)), "row_id")
    return df.withColumns({name: (F.row_number().over(by(c)) - 1).cast("long") for name, c in columns.items()})


def gathered(parts: list[tuple[DataFrame, dict[str, float]]]) -> DataFrame:
    """One row per (qid, row_id) that any part has, with the columns of all parts: one tall union, summed up once.

    parts: (table, default per column), a row per pair; a pair that a part lacks gets its defaults.
    """
    every = {n: d for _, defaults in parts for n, d in defaults.items()}
    out = None
    for df, defaults in parts:
        one = df.select("qid", "row_id", *[(F.col(n).cast("double") if n in defaults else F.lit(None).cast("double")).alias(n) for n in every])
        out = one if out is None else out.unionByName(one)
    return out.groupBy("qid", "row_id").agg(*[F.coalesce(F.max(n), F.lit(float(d))).alias(n) for n, d in every.items()])


def features(cands: DataFrame, parts: list[tuple[DataFrame, dict[str, float]]], listed: DataFrame, query_table: DataFrame, centres: DataFrame, trans: DataFrame, totals: DataFrame, models: list[str]) -> DataFrame:
    """The feature table of the candidates.

    parts: as for :func:`gathered`, by the row that a candidate is or is a copy of (``base``); everything about items
    comes by row_id from ``listed``, about queries by qid. Then relative scores, distance, and ranks within each query.
    """
    defaults = {n: d for _, one in parts for n, d in one.items()}
    scores = gathered(parts).withColumnRenamed("row_id", "base")
    f = source_flags(cands, 3 + 2 * len(models)).join(scores, ["qid", "base"], "left").fillna(defaults)
    items = listed.select("row_id", F.col("item_location_id").alias("l"), "item_latitude", "item_longitude", *[c.alias(n) for n, c in N.item_features().items()])
    f = f.join(query_table, "qid").join(items, "row_id").join(centres.withColumnRenamed("loc", "s"), "s", "left")
    f = log_prior(f, trans, totals)
    f = f.withColumn("same_loc", N.same_location(F.col("s"), F.col("l"))).withColumn("dist", N.distance_feature(N.haversine_km(F.col("lat"), F.col("lon"), F.col("item_latitude"), F.col("item_longitude"))))
    f = relative_scores(f, models)
    f = f.withColumns({f"_loc_{m}": F.col(f"dense_{m}") + F.lit(BETA_DENSE) * F.col("lp") for m in models} | {"_bm_loc": F.col("bm_comb") + F.lit(BETA_BM25) * F.col("lp")})
    ranks = {"rk_bm_comb": "bm_comb", "rk_hist_knn": "hist_knn"} | {f"rk_dense_{m}": f"dense_{m}" for m in models} | {f"rk_dense_loc_{m}": f"_loc_{m}" for m in models} | {"rk_dense_loc_mean": "dense_loc_rel_mean", "rk_bm_loc": "_bm_loc"}
    return rank_within(f, ranks).drop("base", "s", "l", "lat", "lon", "item_latitude", "item_longitude", "_bm_loc", *[f"_loc_{m}" for m in models], *[f"dnl_max_{m}" for m in models])
