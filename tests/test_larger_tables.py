"""Steps whose memory must not grow with pairs or with what files hide: results by brute force, and the plans chosen."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import chargram as G
from marlstone.operators import dense as D
from marlstone.operators import history as H
from marlstone.plans import all_queries, search_queries
from marlstone.sources.stages import measured_broadcasts

SF = "/root/testdata/sf0.001"
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def limits(spark):
    """Spark's own limits of broadcasts, and afterwards those from before."""
    old = {c: spark.conf.get(c, None) for c in (ESTIMATED, MEASURED)}
    for c in old:
        spark.conf.unset(c)
    yield
    for c, v in old.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_tables_are_broadcast_by_measured_size(spark, limits, tmp_path):
    spark.range(400_000).select("id", F.lit("a title that every row repeats").alias("title")).write.parquet(str(tmp_path / "t"))
    big = lambda: spark.read.parquet(str(tmp_path / "t"))
    joins = lambda: big().join(big().withColumnRenamed("title", "b"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joins()
    measured_broadcasts(spark)
    assert "BroadcastHashJoin" not in joins()
    assert spark.conf.get(MEASURED) == str(10 << 20)


def test_train_view_reads_measured_sizes(spark, limits):
    all_queries()["g2_sample_texts"]
    search_queries.view(spark, SF, "train_v")
    assert int(spark.conf.get(ESTIMATED)) < int(spark.conf.get(MEASURED))


def _history(spark):
    rng = random.Random(7)
    chosen = [(f"t{rng.randrange(12)}", rng.randrange(60), rng.choice([1, 2, 3, None]), rng.randrange(1, 5)) for _ in range(500)]
    chosen += [(f"t{k % 12}", 100 + k, rng.choice([1, 2, 3]), rng.randrange(1, 4)) for k in range(200)]  # of one text each
    chosen = list({c[:3]: c for c in chosen}.values())
    near = [(f"q{q}", f"t{t}", round(rng.random(), 6)) for q in range(40) for t in rng.sample(range(12), 6)]
    queries = [(f"q{q}", q % 3 - 1, f"t{q % 12}", rng.choice([1, 2, 3, 9, None])) for q in range(40)]
    rows = [(r, r % 7 != 0, [r % 2, 5] if r % 7 == 0 else None) for r in [*range(60), *range(100, 300)]]
    return (
        spark.createDataFrame(near, "qid string, text string, sim double"),
        spark.createDataFrame(chosen, "text string, row_id long, loc int, c long"),
        spark.createDataFrame(queries, "qid string, fold int, search_query string, search_location_id int"),
        spark.createDataFrame(rows, "row_id long, in_bench boolean, folds array<long>"),
    )


def plain(rows):
    return sorted((r["qid"], r["row_id"], *(round(r[c], 7) for c in r.asDict() if c not in ("qid", "row_id"))) for r in rows)


def test_history_lists_are_those_of_all_pairs(spark):
    nb, chosen, queries, corpus = _history(spark)
    # Every third row has a copy, which stands in a fold of its own.
    copies = corpus.where("row_id % 3 = 0").select((F.col("row_id") + 1000).alias("row_id"), F.col("row_id").alias("base"), F.lit(False).alias("in_bench"), F.array(F.lit(1).cast("long")).alias("folds"))
    listed = corpus.select("row_id", F.col("row_id").alias("base"), "in_bench", "folds").unionByName(copies)
    every = corpus.withColumns({"in_bench": F.lit(True)})
    pairs = H.history_scores(nb, chosen, queries, every, 0.2).withColumnRenamed("row_id", "base").join(listed, "base").join(queries.select("qid", "fold"), "qid")
    want = H.history_topk(pairs.where(H.visible(F.col("fold"), F.col("in_bench"), F.col("folds"))), 9).select("qid", "row_id", "hist_knn", "rank").collect()
    for block in (4096, 5):
        got = H.history_lists(nb, H.items_of_texts(chosen), queries, listed, 9, 0.2, block=block)
        assert plain(got.collect()) == plain(want)


def test_history_of_given_pairs(spark):
    nb, chosen, queries, corpus = _history(spark)
    want = H.history_scores(nb, chosen, queries, corpus.withColumn("in_bench", F.lit(True)), 0.2)
    pairs = queries.select("qid").crossJoin(corpus.select("row_id"))
    got = H.pair_history(pairs, nb, H.items_of_texts(chosen), queries, 0.2)
    assert got.count() == pairs.count()
    assert plain(got.where("hist_knn > 0").collect()) == plain(want.collect())


def test_metrics_make_features_of_judged_queries_only(spark):
    all_queries()["m12_report"](spark, SF).collect()
    place = (spark.sparkContext.applicationId, SF)
    from marlstone.plans import rank_queries

    judged = search_queries._made[(rank_queries.RankedJudged, *place)].scored
    assert judged.where("fold < 0").count() == 0 and judged.count() > 0


def test_similarity_inside_locations_makes_no_table_of_pairs(spark):
    rng = random.Random(3)
    title = lambda: rng.choice([" ".join(rng.sample(["red", "blue", "lamp", "tables", "ox"], 2)), "", None, "é ü"])
    items = spark.createDataFrame([(k, rng.choice([1, 2, 3, None]), title()) for k in range(150)], "row_id long, loc int, text string")
    queries = spark.createDataFrame([(f"q{k}", rng.choice([1, 2, 7, None]), title()) for k in range(40)], "qid string, loc int, text string")
    model = G.fit(items, "row_id", "text")
    pairs = queries.select("qid", "loc").join(items.select("row_id", "loc"), "loc").select("qid", "row_id")
    vectors = lambda df, key: G.vectors(df, model, key, "text")
    want = G.similarity(pairs, vectors(queries, "qid"), vectors(items, "row_id")).withColumn("char_t", F.round("char_t", 5)).collect()
    assert any(r["char_t"] > 0 for r in want)
    for block in (1024, 3):
        got = G.location_similarity(queries, items, model, block=block)
        assert plain(got.collect()) == plain(want)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert G.location_similarity(queries.where("loc = 7"), items, model).count() == 0


@pytest.mark.parametrize("weight", [0.0, 0.03])
def test_lists_of_classes_are_those_of_all_rows(spark, weight):
    rng = random.Random(11)
    vectors = [[rng.choice([0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(6)]
    items = spark.createDataFrame([(k, rng.choice(vectors)) for k in range(120)], "row_id long, vec array<float>")
    folds = lambda: rng.choice([(True, None), (True, None), (False, [0]), (False, [0, 1])])
    places = [(k, None, rng.choice([1, 2]), *folds()) for k in range(120)] + [(200 + k, k * 3, rng.choice([1, 2]), *folds()) for k in range(30)]
    places = spark.createDataFrame(places, "row_id long, src_row long, loc int, in_bench boolean, folds array<long>")
    queries = spark.createDataFrame([(f"q{k}", k % 2, rng.choice([1, 2, 9]), rng.choice(vectors)) for k in range(50)], "qid string, fold int, loc int, vec array<float>")
    trans = spark.createDataFrame([(1, 1, 5), (1, 2, 2), (2, 1, 1)], "s int, l int, c long")
    want = D.block_topk(D.query_priors(queries, trans) if weight else queries, D.placed(items, places), 9, weight=weight).select("qid", "row_id", "score", "rank").collect()
    found, members = D.classes(items, places, ["vec"], 9)
    assert found.count() <= 6 and members.count() < 50
    got = D.class_topk(queries, found, members, 9, ["vec"], weight, trans)
    assert plain(got.collect()) == plain(want)


def test_affinity_of_history_pairs(spark):
    nb, chosen, queries, corpus = _history(spark)
    corpus = corpus.withColumn("item_microcat_id", F.when(F.col("row_id") % 5 > 0, F.col("row_id") % 5))
    mix = queries.select("qid", F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("mc")).withColumn("p", F.col("mc") / 10).where("qid <> 'q3'")
    want = H.microcat_affinity(H.history_scores(nb, chosen, queries, corpus, 0.2), mix, corpus)
    got = H.history_affinity(nb, chosen, queries, corpus, mix, 0.2)
    assert plain(got.collect()) == plain(want.collect())
