"""Metrics, the ranker and its ensemble, and the order of the answer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SERVICE_CATEGORY = 114
ANSWER, RESERVE, RESERVE_RANK = 50, 5, 100
SEED = 42
#: A feature that is not known.
UNKNOWN = -1.0


def drop_useless(cands: DataFrame) -> DataFrame:
    """The rows of queries with a positive candidate."""
    return cands.join(cands.where("label = 1").select("qid").distinct(), "qid", "left_semi")


def n_relevant(queries: DataFrame) -> DataFrame:
    return queries.where("rel is not null").select("qid", "fold", F.size("rel").alias("n_rel"))


def recall_at(cands: DataFrame, score: str, n_rel: DataFrame, k: int = ANSWER) -> DataFrame:
    """(fold, recall): hits among the best k over all relevant items, a query without candidates counting as 0."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 6)), "row_id")
    hits = cands.select("qid", "row_id", "label", score).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).groupBy("qid").agg(F.sum("label").cast("double").alias("hits"))
    return n_rel.join(hits, "qid", "left").groupBy("fold").agg(F.avg(F.coalesce("hits", F.lit(0.0)) / F.col("n_rel")).alias("recall"))


def single_source_recall(cands: DataFrame, rank_columns: list[str], n_rel: DataFrame, k: int = ANSWER) -> DataFrame:
    """(source, recall) of each rank column alone, which are ranks already: no ordering is needed."""
    pairs = ", ".join(f"'{c}', cast({c} as long)" for c in rank_columns)
    long = cands.selectExpr("qid", "label", f"stack({len(rank_columns)}, {pairs}) as (source, rank)").where(F.col("rank") < k)
    hits = long.groupBy("source", "qid").agg(F.sum("label").cast("double").alias("hits"))
    every = n_rel.select("qid", "n_rel", F.explode(F.array(*map(F.lit, rank_columns))).alias("source"))
    return every.join(hits, ["source", "qid"], "left").groupBy("source").agg(F.avg(F.coalesce("hits", F.lit(0.0)) / F.col("n_rel")).alias("recall"))


def ndcg_at(cands: DataFrame, score: str, k: int = ANSWER) -> DataFrame:
    """(qid, ndcg) of queries with a positive candidate, gains 0 and 1."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 6)), "row_id")
    r = cands.select("qid", "row_id", "label", score).withColumn("rn", F.row_number().over(w))
    gain = lambda c: F.lit(1.0) / F.log2(c + F.lit(1.0))
    dcg = r.groupBy("qid").agg(F.sum(F.when((F.col("rn") <= k) & (F.col("label") == 1), gain(F.col("rn"))).otherwise(0.0)).alias("dcg"), F.sum("label").cast("int").alias("n")).where("n > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k))), F.lit(0.0), lambda s, i: s + gain(i.cast("double")))
    return dcg.select("qid", (F.col("dcg") / ideal).alias("ndcg"))


def fold_split(cands: DataFrame, evaluate: int, stop: int = 6) -> DataFrame:
    """``cands`` of validation folds with part: evaluate, stop or train."""
    part = F.when(F.col("fold") == evaluate, "evaluate").when(F.col("fold") == stop, "stop").otherwise("train")
    return cands.where("fold >= 0").withColumn("part", part)


def known(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with missing features as UNKNOWN, in training as in use: Spark ML takes no others."""
    return df.withColumns({c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(UNKNOWN)), F.lit(UNKNOWN)) for c in features})


def train_ranker(train: DataFrame, features: list[str], rounds: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 1, sample: float = 1.0):
    """Gradient-boosted trees on single pairs, each query's pairs weighing 1 together: a fitted Spark ML pipeline.

    A pairwise or listwise objective is not part of Spark ML. ``sample`` is the share of the rows that a tree sees, so
    that seeds differ; rows are in order of query and row, if they have one, so that a seed draws the same ones again.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = known(train, features).withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("qid"))).withColumn("label", F.col("label").cast("double"))
    rows = rows.sortWithinPartitions("qid", *[c for c in ("row_id",) if c in rows.columns])
    vector = VectorAssembler(inputCols=features, outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=sample)
    return Pipeline(stages=[vector, trees]).fit(rows)


class Ensemble:
    """A model's trees as arrays, one row per node: feature (-1: a leaf), threshold, children and weighted value."""

    def __init__(self, model):
        trees = model.stages[-1]
        self.trees = [self._rows(t._java_obj.rootNode(), w) for t, w in zip(trees.trees, trees.treeWeights)]

    @staticmethod
    def _rows(root, weight: float) -> tuple[np.ndarray, ...]:
        rows: list[list[float]] = []

        def add(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, at, at, weight * node.prediction()])
            if node.subtreeDepth():
                rows[at][:2] = node.split().featureIndex(), node.split().threshold()
                rows[at][2], rows[at][3] = add(node.leftChild()), add(node.rightChild())
            return at

        add(root)
        feature, threshold, left, right, value = zip(*rows)
        return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows x trees): the running sum of the trees' values, which is the score after each tree."""
        out = np.empty((len(x), len(self.trees)))
        for k, (feature, threshold, left, right, value) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            while (live := np.flatnonzero(feature[at] >= 0)).size:
                node = at[live]
                at[live] = np.where(x[live, feature[node]] <= threshold[node], left[node], right[node])
            out[:, k] = value[at]
        return out.cumsum(axis=1)


def staged_ndcg(model, cands: DataFrame, features: list[str], k: int = ANSWER) -> list[float]:
    """Mean nDCG@k over the queries of ``cands`` with a positive candidate, after each tree of the model.

    A query's candidates are as many as the source lists hold, so a task holds one query's at a time.
    """
    import pandas as pd

    trees = Ensemble(model)

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        label, order = rows["label"].to_numpy(np.float64), rows["row_id"].to_numpy().argsort(kind="stable")
        if not label.any():
            return pd.DataFrame({"tree": [], "ndcg": []})
        margins = trees.margins(rows[features].to_numpy(np.float64))[order]
        best = np.argsort(-margins, axis=0, kind="stable")[:k]
        gain = 1 / np.log2(np.arange(2, k + 2))
        dcg = (label[order][best] * gain[: len(best), None]).sum(axis=0)
        return pd.DataFrame({"tree": np.arange(margins.shape[1]), "ndcg": dcg / gain[: int(label.sum())].sum()})

    each = known(cands.select("qid", "row_id", "label", *features), features).groupBy("qid").applyInPandas(judge, "tree int, ndcg double")
    return [r["ndcg"] for r in each.groupBy("tree").agg(F.avg("ndcg").alias("ndcg")).orderBy("tree").collect()]


def stopped_ranker(train: DataFrame, valid: DataFrame, features: list[str], most: int = 3000, patience: int = 30, first: int = 60, k: int = ANSWER, **shape):
    """(model, curve): the trees up to the best nDCG@k on ``valid``, and its values after each tree that was tried.

    Trees are added until none of the last ``patience`` has raised the metric, or there are ``most``. Spark ML cannot go
    on from a fitted ensemble: a fit that was too short is made again with twice the trees, the first of which are the
    same, and the trees past the best are left off at last.
    """
    rounds = min(first, most)
    while True:
        model = train_ranker(train, features, rounds=rounds, **shape)
        curve = staged_ndcg(model, valid, features, k)
        best = int(np.argmax(curve)) + 1 if curve else rounds
        if len(curve) - best >= patience or rounds >= most or not curve:
            return (train_ranker(train, features, rounds=best, **shape) if best < rounds else model), curve
        rounds = min(2 * rounds, most)


def n_trees(model) -> int:
    """The trees of a model: the best number, where it was stopped."""
    return model.stages[-1].getNumTrees


def final_predictions(train: DataFrame, cands: DataFrame, features: list[str], trees: int, seeds: int = 3, sample: float = 0.8, **shape) -> DataFrame:
    """(seed, qid, row_id, pred): ``cands`` judged by one model per seed, each fitted to all of ``train``."""
    out = None
    for seed in range(seeds):
        model = train_ranker(train, features, rounds=trees, seed=SEED + seed, sample=sample, **shape)
        one = predict(model, cands).select(F.lit(seed).alias("seed"), "qid", "row_id", "pred")
        out = one if out is None else out.unionByName(one)
    return out


def predict(model, cands: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(known(cands, model.stages[0].getInputCols())).withColumn("pred", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(spark, model, features: list[str], n: int = 20) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def rank_ensemble(preds: DataFrame) -> DataFrame:
    """(qid, row_id, score): sum over seeds of the average rank of the prediction in its query, over the query's size.

    preds: seed, qid, row_id, pred. Equal predictions share the mean of their ranks; a higher one ranks higher.
    """
    part = Window.partitionBy("seed", "qid")
    peers = F.count("*").over(Window.partitionBy("seed", "qid", "pred"))
    average = F.rank().over(part.orderBy("pred")) + (peers - 1) / F.lit(2.0)
    r = preds.withColumn("r", average / F.count("*").over(part))
    return r.groupBy("qid", "row_id").agg(F.sum("r").alias("score"))


def top_items(scored: DataFrame, k: int = ANSWER) -> DataFrame:
    """``scored`` with rank from 1 by score, then row; the first k of each query."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "row_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reserve_slots(scored: DataFrame, queries: DataFrame, k: int = ANSWER, n: int = RESERVE, max_rank: int = RESERVE_RANK) -> DataFrame:
    """(qid, row_id, rank, forced): the top k, whose last places go to goods for benchmark queries over all categories.

    The first n candidates outside the service category with a mean dense rank below ``max_rank`` are chosen by that
    rank, then row; those that the top already has are dropped, and the others replace the end of the list.
    scored: qid, row_id, score, category, rk_dense_loc_mean.
    """
    top = top_items(scored, k).select("qid", "row_id", "rank")
    wide = queries.where("fold = -1 and search_category = 0").select("qid")
    w = Window.partitionBy("qid").orderBy("rk_dense_loc_mean", "row_id")
    goods = scored.where((F.col("category") != SERVICE_CATEGORY) & (F.col("rk_dense_loc_mean") < max_rank)).join(wide, "qid", "left_semi")
    goods = goods.withColumn("g", F.row_number().over(w)).where(F.col("g") <= n).select("qid", "row_id", "g")
    new = goods.join(top.select("qid", "row_id"), ["qid", "row_id"], "left_anti")
    new = new.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("g")))
    count = new.groupBy("qid").agg(F.count("*").alias("extra"))
    kept = top.join(count, "qid", "left").where(F.col("rank") <= k - F.coalesce("extra", F.lit(0)))
    room = kept.groupBy("qid").agg(F.count("*").alias("kept"))
    tail = new.join(room, "qid", "left").select("qid", "row_id", (F.coalesce("kept", F.lit(0)) + F.col("place")).cast("long").alias("rank"), F.lit(True).alias("forced"))
    return kept.select("qid", "row_id", F.col("rank").cast("long").alias("rank"), F.lit(False).alias("forced")).unionByName(tail)


def answer(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = ANSWER) -> DataFrame:
    """(query_id, answer): every benchmark query with at most k distinct benchmark item ids in order, or ''."""
    ids = corpus.where("in_bench").select("row_id", "item_id")
    rows = ranked.join(ids, "row_id").groupBy("qid", "item_id").agg(F.min("rank").alias("rank"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "item_id"))).where(F.col("rn") <= k)
    lists = rows.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "item_id"))), lambda s: s["item_id"]), " ").alias("answer"))
    return queries.where("fold = -1").select(F.col("qid").alias("query_id")).join(lists.withColumnRenamed("qid", "query_id"), "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


def answer_sizes(ans: DataFrame) -> DataFrame:
    return ans.select("query_id", F.when(F.col("answer") == "", 0).otherwise(F.size(F.split("answer", " "))).alias("n"))


def answer_stats(ans: DataFrame, ranked: DataFrame) -> DataFrame:
    """rows, least and mean items per query, and how many places were reserved."""
    forced = ranked.agg(F.coalesce(F.sum(F.col("forced").cast("long")), F.lit(0)).alias("forced"))
    return answer_sizes(ans).agg(F.count("*").alias("rows"), F.min("n").cast("long").alias("min_items"), F.avg("n").alias("mean_items")).join(F.broadcast(forced))


def report(per_fold: DataFrame) -> DataFrame:
    """Mean recall and best iteration over the reported folds: fold, recall, iterations."""
    return per_fold.agg(F.avg("recall").alias("mean_recall"), F.avg("iterations").alias("mean_iterations"), F.count("*").alias("folds"))
