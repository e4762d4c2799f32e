"""Hand-worked cases and invariants of the search operators."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import numbering, numeric, rng, stem, text
from marlstone.operators import answer_checks, bm25, candidates, chargram, competitors, dense, location, pairs, prepare, ranking
from marlstone.sources import stages


def test_normalize_and_tokens(spark):
    df = spark.createDataFrame([(1, "Ёлка, ёж-2 и КОТ"), (2, None), (3, "!?")], "id long, t string")
    assert {r["id"]: r["n"] for r in df.select("id", text.normalize("t").alias("n")).collect()} == {1: "елка еж 2 и кот", 2: "", 3: ""}
    assert [(r["pos"], r["token"]) for r in text.drop_stop(text.tokens(df, "id", "t", 4)).orderBy("pos").collect()] == [(0, "елка"), (1, "еж"), (2, "2")]


def test_bigrams_bridge_dropped_words(spark):
    df = spark.createDataFrame([(1, "ремонт и отделка квартир")], "id long, t string")
    got = text.bigrams(bm25.unigrams(df, "id", "t"), ["id"]).orderBy("pos").collect()
    assert [r["term"] for r in got] == ["ремонт§отделка", "отделка§квартир"]


def test_char_ngrams(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("abcde",), ("",)], "t string")
    got = {r["t"]: r["g"] for r in df.select("t", text.char_ngrams("t").alias("g")).collect()}
    assert got["a"] == [" a "] and got["ab"] == [" ab", "ab ", " ab "] and got[""] == []
    assert got["abcde"] == [" ab", "abc", "bcd", "cde", "de ", " abc", "abcd", "bcde", "cde "]


def test_stems():
    assert [stem.stem_token(w) for w in ("важнейшие", "вагонами", "услуги", "generously", "hoping", "relational", "skies")] == ["важн", "вагон", "услуг", "generous", "hope", "relat", "sky"]


def test_bm25_of_three_documents(spark):
    df = spark.createDataFrame([(1, "red car", "x", ""), (2, "red", "x", "car car"), (3, "", "", "")], "row_id long, title string, params string, description string")
    p = {(r["field"], r["term"], r["row_id"]): r["w"] for r in bm25.bm25_postings(df).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    avg = 4 / 3  # the title of the first counts its bigram
    assert p["title", "red", 1] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.7 + 0.3 * 3 / avg)))
    assert p["desc", "car", 2] == pytest.approx(math.log(1 + 2.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / (2 / 3))))
    assert ("title", "red§car", 1) in p
    q = bm25.query_terms(spark.createDataFrame([("q", "car red unknown red")], "qid string, query string"), bm25.vocabulary(bm25.bm25_postings(df)))
    assert {(r["term"], r["n_terms"]) for r in q.collect()} == {("car", 2), ("red", 2)}


def test_terms_are_those_of_the_token_table(spark):
    df = spark.createDataFrame([(1, "running cars и hoping cars", "услуги", None), (2, "", None, "generously generously"), (3, "relational", "a", "b c b b")], "row_id long, title string, params string, description string")
    for stemmer in (bm25.identity, stem.snowball):
        want = Counter()
        for f in bm25.FIELDS:
            uni = bm25.unigrams(df, "row_id", f.column, f.max_tokens, stemmer)
            want.update((f.name, r["row_id"], r["term"]) for r in uni.collect())
            want.update((f.name, r["row_id"], r["term"]) for r in text.bigrams(uni, ["row_id"]).collect() if f.bigrams)
        rows = bm25.row_terms(df, stem=stemmer).collect()
        assert {(r["field"], r["row_id"], r["term"]): r["tf"] for r in rows} == want
        length = Counter()
        for (field, row, _), n in want.items():
            length[field, row] += n
        assert all(r["dl"] == length[r["field"], r["row_id"]] for r in rows)


def word_corpus(spark, n=300, seed=3):
    g = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    p = 1 / np.arange(1, 61)
    draw = lambda m: " ".join(g.choice(words, m, p=p / p.sum()))
    rows = [(k, draw(g.integers(0, 6)), draw(1), draw(g.integers(0, 40)), k % 5 if k % 3 else 0) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, title string, params string, description string, loc int"), spark.createDataFrame([(f"q{k}", draw(3)) for k in range(12)] + [("none", "unknown")], "qid string, query string")


def test_topk_from_bounded_chunks_equals_all(spark):
    corpus, queries = word_corpus(spark, 150)
    chunks = stages.kept(bm25.in_chunks(corpus, bm25.length_class("title"), 4))
    index = bm25.block_index(chunks, part=40)
    assert index.terms.where("parts > 1").count() > 0
    postings = stages.kept(bm25.bm25_postings(corpus))
    terms = stages.kept(bm25.query_terms(queries, bm25.vocabulary(index)))
    assert sorted(map(tuple, terms.collect())) == sorted(map(tuple, bm25.query_terms(queries, bm25.vocabulary(postings)).collect()))
    key = lambda df: {(r["qid"], r["row_id"]): tuple(round(r[c], 9) for c in df.columns if c.startswith(("bm", "cov"))) for r in df.collect()}
    every = key(bm25.bm25_combine(terms, postings))
    assert key(bm25.bm25_combine(terms, index)) == every and key(bm25.coverage(terms, index)) == key(bm25.coverage(terms, postings))
    some = spark.createDataFrame(sorted(every)[::7] + [("q1", 149)], "qid string, row_id long")
    found = bm25.pair_matches(terms, index, some, chunks)
    asked = {(r["qid"], r["row_id"]) for r in some.collect()}
    assert key(bm25.combined(found)) == {k: v for k, v in every.items() if k in asked}
    bounds = {(r["qid"], r["place"], r["chunk"]): r["bound"] for r in bm25.chunk_bounds(terms, index).collect()}
    at = {r["row_id"]: (r["place"], r["chunk"]) for r in chunks.collect()}
    assert all(bounds[q, *at[row]] >= v[3] - 1e-9 for (q, row), v in every.items())
    for k in (2, 1000):
        listed, chosen = bm25.bm25_topk(terms, index, k)
        got = {}
        for r in listed.collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["row_id"]))
        for q in {q for q, _ in every}:
            best = sorted((row for p, row in every if p == q), key=lambda row: (-round(every[q, row][3], 6), row))[:k]
            assert [row for _, row in sorted(got[q])] == best
        assert k > 2 or chosen.count() < 0.8 * len(bounds)


def test_copies_are_listed_where_they_stand(spark):
    corpus, queries = word_corpus(spark, 80)
    corpus = corpus.withColumn("item_location_id", F.col("loc")).withColumn("in_bench", F.col("row_id") % 4 != 1).withColumn("folds", F.when(F.col("row_id") % 4 == 1, F.array(F.lit(2).cast("long"))))
    copies = spark.createDataFrame([(1000 + k, k % 20 * 4, (k * 7) % 5, [k % 3]) for k in range(40)], "row_id long, base long, item_location_id int, folds array<long>")
    listed = corpus.select("row_id", F.col("row_id").alias("base"), "item_location_id", "in_bench", "folds").unionByName(copies.withColumn("in_bench", F.lit(False)).select("row_id", "base", "item_location_id", "in_bench", "folds"))
    number = F.substring("qid", 2, 2).try_cast("int")
    asked = queries.where("qid <> 'none'").select("qid", (number % 3).alias("fold"), (number % 5).alias("search_location_id"), "query").cache()
    trans = spark.createDataFrame([(s, (s + k) % 5, 9 - 2 * k) for s in range(4) for k in range(3)], "s int, l int, c long")
    totals = location.location_totals(trans)
    chunks = stages.kept(bm25.in_chunks(corpus, F.col("loc"), 4))
    index = bm25.block_index(chunks)
    terms = bm25.query_terms(asked, bm25.vocabulary(index)).cache()
    scores = {(r["qid"], r["row_id"]): r["bm_comb"] for r in bm25.bm25_combine(terms, index).collect()}
    lps = {(r["s"], r["l"]): r["lp"] for r in location.log_prior(spark.createDataFrame([(s, l) for s in range(5) for l in range(5)], "s int, l int"), trans, totals).collect()}
    rows = listed.collect()
    with_prior, plain = candidates.bm25_lists(terms, index, asked, listed, chunks, trans, totals, 6, 4)
    for got, k, beta in ((with_prior, 6, 2.0), (plain, 4, 0.0)):
        by = {}
        for r in got.collect():
            by.setdefault(r["qid"], []).append((r["rank"], r["row_id"]))
        for q in asked.collect():
            seen = [(round(scores[q["qid"], r["base"]] + beta * lps[q["search_location_id"], r["item_location_id"]], 6), r["row_id"]) for r in rows if (q["qid"], r["base"]) in scores and (r["in_bench"] or q["fold"] in (r["folds"] or []))]
            assert [x for _, x in sorted(by.get(q["qid"], []))] == [row for _, row in sorted(seen, key=lambda p: (-p[0], p[1]))[:k]]


def test_distance_and_prior(spark):
    km = spark.range(1).select(numeric.haversine_km(*map(F.lit, (55.7558, 37.6173, 59.9343, 30.3351))).alias("km")).first()["km"]
    assert km == pytest.approx(633, abs=3)
    trans = spark.createDataFrame([(1, 1, 8), (1, 2, 2)], "s int, l int, c long")
    pairs_ = spark.createDataFrame([(1, 1), (1, 3), (9, 9), (9, 1)], "s int, l int")
    got = {(r["s"], r["l"]): r["lp"] for r in location.log_prior(pairs_, trans, location.location_totals(trans)).collect()}
    assert got[1, 1] == pytest.approx(math.log(8.001 / 11)) and got[1, 3] == pytest.approx(math.log(0.001 / 11))
    assert got[9, 9] == pytest.approx(math.log(0.8)) and got[9, 1] == pytest.approx(math.log(1e-4))


@pytest.mark.parametrize("block", [3, 17, 1000])
def test_block_topk_equals_brute_force(spark, block):
    g = np.random.default_rng(1)
    q, i = g.normal(size=(9, 8)), g.normal(size=(60, 8))
    queries = spark.createDataFrame([(k, v.tolist(), k % 3, k % 2) for k, v in enumerate(q)], "qid long, vec array<double>, loc int, fold int")
    items = spark.createDataFrame([(k, v.tolist(), k % 3, k % 4 != 0, [0] if k % 8 == 0 else [1] if k % 4 == 0 else None) for k, v in enumerate(i)], "row_id long, vec array<double>, loc int, in_bench boolean, folds array<long>")
    sim = np.round(q @ i.T, 6)
    for place in ("any", "same", "other"):
        got = {}
        for r in dense.block_topk(queries, items, 4, place=place, block=block).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["row_id"]))
        for k in range(9):
            ok = [j for j in range(60) if (j % 4 or (j % 8 == 0) == (k % 2 == 0)) and (place == "any" or (j % 3 == k % 3) == (place == "same"))]
            assert [x for _, x in sorted(got[k])] == sorted(ok, key=lambda j: (-sim[k, j], j))[:4]


@pytest.mark.parametrize("block", [7, 1000])
def test_placed_vectors_equal_copied_ones(spark, block):
    g = np.random.default_rng(5)
    q, i = g.normal(size=(11, 6)), g.normal(size=(40, 6))
    trans = spark.createDataFrame([(s, l, 1 + (s * l) % 7) for s in range(3) for l in range(4)], "s int, l int, c long")
    queries = dense.query_priors(spark.createDataFrame([(k, v.tolist(), k % 4, k % 3) for k, v in enumerate(q)], "qid long, vec array<double>, loc int, fold int"), trans)
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(i)], "row_id long, vec array<double>")
    places = spark.createDataFrame([(k, None, k % 4, k % 5 > 0, [k % 3] if k % 5 == 0 else None) for k in range(40)] + [(100 + k, k % 9, (k * 3) % 4, False, [k % 3, 0]) for k in range(30)], "row_id long, src_row long, loc int, in_bench boolean, folds array<long>")
    copied = places.join(items.withColumnRenamed("row_id", "of"), F.coalesce("src_row", "row_id") == F.col("of")).drop("of", "src_row")
    for weight, place in ((0.0, "any"), (0.4, "any"), (0.4, "other")):
        a, b = (sorted(map(tuple, dense.block_topk(queries, df, 9, weight=weight, place=place, block=block).collect())) for df in (dense.placed(items, places), copied))
        assert a == b and len(a) == 99


@pytest.mark.parametrize("block,asked", [(5, 3), (1000, 1000)])
def test_pair_scores_are_gathered(spark, block, asked):
    g = np.random.default_rng(6)
    q, i = g.normal(size=(20, 7)), g.normal(size=(50, 7))
    queries = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(q)], "qid string, vec array<double>")
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(i)], "row_id long, vec array<double>")
    rows = [(f"q{a}", b) for a in range(20) for b in range(50) if (a * b) % 3 == 0] + [("q1", 5), ("q99", 1), ("q1", 77)]
    got = Counter(map(tuple, dense.score_pairs(spark.createDataFrame(rows, "qid string, row_id long"), queries, items, block, asked).collect()))
    assert got == Counter((a, b, round(float(q[int(a[1:])] @ i[b]), 6)) for a, b in rows if int(a[1:]) < 20 and b < 50)
    assert dense.score_pairs(spark.createDataFrame(rows, "qid string, row_id long").limit(0), queries, items).collect() == []


def test_a_crowded_location_leaves_the_others_alone(spark):
    rows = [(k, 0 if k < 900 else 1 + k % 60, [math.sin(k), math.cos(k), 0.1]) for k in range(1200)]
    items = spark.createDataFrame(rows, "row_id long, loc int, vec array<double>")
    queries = spark.createDataFrame([(f"q{k}", *r) for k, *r in rows[::3]], "qid string, loc int, vec array<double>")
    blocks = {r["loc"]: (r["nq"], r["ni"]) for r in dense.location_blocks(queries, items, 10).collect()}
    assert blocks[0] == (30, 90) and all(v == (1, 1) for k, v in blocks.items() if k)
    # Rows that travel: those of the crowded location by its own blocks, the others once.
    got = dense.block_topk(queries, items, 4, place="same", block=10)
    want = dense.block_topk(queries, items, 4, place="same", block=5000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gathered_parts(spark):
    a = spark.createDataFrame([("q", 1, 2.0), ("q", 2, -3.0)], "qid string, row_id long, x double")
    b = spark.createDataFrame([("q", 2, 5), ("r", 1, None)], "qid string, row_id long, y int")
    got = {(r["qid"], r["row_id"]): (r["x"], r["y"]) for r in candidates.gathered([(a, {"x": 0.0}), (b, {"y": -1.0})]).collect()}
    assert got == {("q", 1): (2.0, -1.0), ("q", 2): (-3.0, 5.0), ("r", 1): (0.0, -1.0)}


def planted(spark, queries, seed):
    """Pairs whose label follows x and z, for the larger part."""
    g = np.random.default_rng(seed)
    rows = []
    for q in range(queries):
        x, y, z = g.normal(size=(3, 20))
        best = int(np.argmax(x + (z > 0) + 0.4 * g.normal(size=20)))
        rows += [(f"{seed}-{q}", k, int(k == best), float(x[k]), float(y[k]), float(z[k]) if k % 7 else float("nan")) for k in range(20)]
    return spark.createDataFrame(rows, "qid string, row_id long, label int, x double, y double, z double")


def test_ranker_stops_at_the_best_number_of_trees(spark):
    features = ["x", "y", "z"]
    train, stop, new = (planted(spark, n, s).coalesce(1).cache() for n, s in ((120, 1), (60, 2), (60, 3)))
    model, curve = ranking.stopped_ranker(train, stop, features, most=40, patience=6, first=10, depth=2, rate=0.5, k=5)
    best = int(np.argmax(curve)) + 1
    assert ranking.n_trees(model) == best <= 34 and len(curve) - best >= 6
    # The curve at the best is the metric of the model that is kept; running sums give its probabilities.
    judged = ranking.predict(model, stop)
    scored = judged.collect()
    trees = ranking.Ensemble(model)
    margin = trees.margins(np.array([[r[c] for c in features] for r in scored]))[:, -1]
    assert np.allclose(1 / (1 + np.exp(-2 * margin)), [r["pred"] for r in scored])
    assert ranking.ndcg_at(judged.withColumn("pred", F.col("pred") * 1e6), "pred", 5).agg(F.avg("ndcg")).first()[0] == pytest.approx(curve[best - 1], abs=0.02)
    assert curve[best - 1] > 0.6
    important = [r["feature"] for r in ranking.feature_importance(spark, model, features).collect()]
    assert important[0] == "x" and important[-1] == "y"
    preds = ranking.final_predictions(train, new, features, best, seeds=2, depth=2, rate=0.5)
    ranked = new.join(ranking.rank_ensemble(preds), ["qid", "row_id"])
    assert ranking.ndcg_at(ranked, "score", 5).agg(F.avg("ndcg")).first()[0] > 0.6


def test_numbers_are_total_whatever_the_partitions(spark):
    df = spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string")))
    want = {r["id"]: n for n, r in enumerate(df.orderBy("h").collect())}
    for parts in (1, 7):
        assert {r["id"]: r["rn"] for r in numbering.numbered(df.repartition(parts), ["h"]).collect()} == want
    assert numbering.numbered(df.limit(0), ["h"]).collect() == []


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(4000)
    a = df.select("id", rng.uniform(1, "t", "id").alias("u"), rng.normal(1, "t", "id").alias("z")).collect()
    assert a == df.repartition(13).select("id", rng.uniform(1, "t", "id").alias("u"), rng.normal(1, "t", "id").alias("z")).orderBy("id").collect()
    u, z = np.array([r["u"] for r in a]), np.array([r["z"] for r in a])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05


GROUPED = "row_key string, search_query string, search_location_id int, search_infm_params_text string, search_category int, search_is_delivery_search boolean, item_id string, row_id long"


def choices(spark, n=600):
    """Four fifths of the rows have one query text and one location."""
    rows = [(f"k{i:04}", "hot" if i % 5 else f"q{i % 37}", 1 if i % 5 else i % 4, None if i % 7 == 0 else "f", 114, i % 2 == 0, f"i{i % 50}", i % 50) for i in range(n)]
    return spark.createDataFrame(rows, GROUPED)


def test_folds_have_no_leak(spark):
    t = choices(spark)
    groups = prepare.search_groups(t)
    folded = prepare.fold_qid(prepare.assign_folds(prepare.one_per_text(groups, prepare.sample_texts(groups, 14)), 7))
    held, hist = prepare.split_history(t, folded)
    rows = folded.collect()
    assert len(rows) == 14 and len({r["search_query"] for r in rows}) == 14
    assert sorted(r["fold"] for r in rows) == sorted([*range(7)] * 2)
    assert held.count() + hist.count() == t.count() and held.join(hist, "row_key").count() == 0
    assert {r["gid"] for r in rows} == {r["gid"] for r in held.select("gid").collect()}


def test_pairs_and_batches(spark):
    capped = pairs.cap_pairs(pairs.distinct_pairs(choices(spark)), 30)
    assert capped.groupBy("search_query").count().agg(F.max("count")).first()[0] <= 30
    b = pairs.unique_batches(capped, 4).collect()
    by = {}
    for r in b:
        by.setdefault((r["layer"], r["batch"]), []).append(r["search_query"])
    assert by and all(len(v) == 4 == len(set(v)) for v in by.values())


def test_drawn_locations_follow_the_shares(spark):
    trans = spark.createDataFrame([(1, 1, 60), (1, 2, 30), (1, 3, 10)], "s int, l int, c long")
    picks = spark.range(3000).select(F.concat(F.lit("q"), "id").alias("qid"), "id", F.lit(1).alias("s")).withColumnRenamed("id", "row_id")
    got = {r["loc"]: r["count"] for r in competitors.draw_location(picks, trans).groupBy("loc").count().collect()}
    assert set(got) == {1, 2, 3} and abs(got[1] - 1800) < 120 and abs(got[3] - 300) < 70
    unknown = competitors.draw_location(picks.limit(5).withColumn("s", F.lit(9)), trans).collect()
    assert all(r["loc"] == 9 for r in unknown)


def test_draws_meet_exactly_one_share_and_one_point(spark):
    g = np.random.default_rng(5)
    trans = spark.createDataFrame([(s, l, int(c)) for s in (1, 2) for l, c in enumerate(g.integers(1, 500, 300))], "s int, l int, c long")
    picks = spark.range(4000).select(F.concat(F.lit("q"), "id").alias("qid"), F.col("id").alias("row_id"), (F.col("id") % 3 + 1).cast("int").alias("s"))
    placed = competitors.draw_location(picks, trans)
    drawn = placed.join(trans.groupBy("s").agg(F.sum("c").alias("total")), "s").withColumn("u", competitors.uniform(competitors.SEED, "loc", "qid", "row_id"))
    shares = {s: np.cumsum([r["c"] for r in trans.where(f"s = {s}").orderBy("l").collect()]) for s in (1, 2)}
    rows = drawn.collect()
    assert placed.count() == 4000 and all(r["loc"] == np.searchsorted(shares[r["s"]] / r["total"], r["u"], side="right") for r in rows)
    spots = spark.createDataFrame([(1, float(i), float(-i), 1 + i % 7) for i in range(50)], "item_location_id int, item_latitude double, item_longitude double, times int")
    points = competitors.location_points(spots.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))), spots.limit(0))
    centres = spark.createDataFrame([(2, 500.0, 500.0)], "loc int, lat double, lon double")
    at = competitors.draw_coordinates(picks.withColumn("loc", F.col("s")), points, centres).collect()
    times = Counter(round(r["lat"]) for r in at if r["loc"] == 1)
    assert len(at) == 4000 and set(times) == set(range(50)) and all(r["lat"] is None for r in at if r["loc"] == 3)
    assert all(round(r["lon"]) == -round(r["lat"]) for r in at if r["loc"] == 1) and sum(times[i] for i in range(6, 50, 7)) > 4 * sum(times[i] for i in range(0, 42, 7))


def test_centres_are_medians(spark):
    g = np.random.default_rng(6)
    rows = [(int(loc), None if g.random() < 0.1 else float(np.round(g.normal(), 1)), float(np.round(g.normal(), 1))) for loc in g.integers(0, 40, 400)]
    items = spark.createDataFrame([*rows, (None, 1.0, 1.0), (99, 3.0, 4.0)], "item_location_id int, item_latitude double, item_longitude double")
    hist = items.limit(0).withColumn("search_location_id", F.lit(1))
    known = {}
    for loc, lat, lon in [*rows, (99, 3.0, 4.0)]:
        if lat is not None:
            known.setdefault(loc, []).append((lat, lon))
    got = {r["loc"]: (r["lat"], r["lon"]) for r in location.centroids(hist, items).collect()}
    assert got.keys() == known.keys() and all(got[k] == pytest.approx(tuple(np.median(v, axis=0))) for k, v in known.items())


SCORED = "qid string, row_id long, score double, category int, rk_dense_loc_mean long, label int"


def test_recall_counts_queries_without_candidates(spark):
    c = spark.createDataFrame([("a", 1, 0.9, 114, 0, 1), ("a", 2, 0.9, 114, 1, 0), ("b", 3, 0.1, 114, 0, 0), ("b", 4, 0.0, 114, 1, 1)], SCORED)
    n = spark.createDataFrame([("a", 0, 2), ("b", 0, 1), ("c", 0, 1)], "qid string, fold int, n_rel int")
    assert ranking.recall_at(c, "score", n, 1).first()["recall"] == pytest.approx(0.5 / 3)
    assert ranking.recall_at(c, "score", n, 2).first()["recall"] == pytest.approx(1.5 / 3)
    assert {r["qid"]: round(r["ndcg"], 6) for r in ranking.ndcg_at(c, "score", 2).collect()} == {"a": 1.0, "b": round(1 / math.log2(3), 6)}


def test_ensemble_averages_ties(spark):
    p = spark.createDataFrame([(1, "q", 1, 0.5), (1, "q", 2, 0.5), (1, "q", 3, 0.9), (1, "q", 4, 0.1)], "seed int, qid string, row_id long, pred double")
    assert {r["row_id"]: r["score"] for r in ranking.rank_ensemble(p).collect()} == {1: 2.5 / 4, 2: 2.5 / 4, 3: 1.0, 4: 0.25}


def test_reserved_places(spark):
    rows = [("q", i, 1 - i / 10, 114, 50 + i, 0) for i in range(6)] + [("q", 20, 0.95, 27, 0, 0), ("q", 21, -1.0, 27, 1, 0), ("q", 22, -2.0, 27, 2, 0)]
    queries = spark.createDataFrame([("q", -1, 0)], "qid string, fold int, search_category int")
    got = ranking.reserve_slots(spark.createDataFrame(rows, SCORED), queries, 4, 2, 20).orderBy("rank").collect()
    # 20 and 21 are chosen first; 20 is in the top already, so one place is replaced.
    assert [(r["row_id"], r["forced"]) for r in got] == [(0, False), (20, False), (1, False), (21, True)]


def test_checks_find_planted_faults(spark):
    ok, bad = "a" * 16, "Z" * 16
    ans = spark.createDataFrame([("q" * 16, f"{ok} {ok}"), ("q" * 16, ""), ("short", bad), ("p" * 16, " ".join([ok] * 51))], "query_id string, answer string")
    queries = spark.createDataFrame([("q" * 16,), ("m" * 16,)], "query_id string")
    items = spark.createDataFrame([(ok,)], "item_id string")
    got = {r["check"]: r["n_bad"] for r in answer_checks.all_checks(ans, queries, items).collect()}
    assert got == {"header": 0, "repeated_query": 1, "query_id_length": 1, "missing_query": 1, "unknown_query": 2, "too_many_items": 1, "repeated_item": 2, "item_id_format": 1, "unknown_item": 1}


def test_chargram_similarity_of_equal_titles_is_one(spark):
    items = spark.createDataFrame([(1, "кот"), (2, "кот"), (3, "пёс")], "row_id long, t string")
    m = chargram.fit(items, "row_id", "t")
    v = chargram.vectors(items, m, "row_id", "t")
    got = chargram.similarity(spark.createDataFrame([(1, 2), (1, 3)], "qid long, row_id long"), v.withColumnRenamed("row_id", "qid"), v).collect()
    assert {r["row_id"]: round(r["char_t"], 6) for r in got} == {2: 1.0, 3: 0.0}


def test_encode_reads_whole_texts(spark, tmp_path):
    from marlstone.plans import all_queries

    head = "a long head " * 60
    texts = [head + "one end", head + "another end", "short", "", None, head[:640]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: np.array(r["vec"]) for r in all_queries()["f1_encode"](spark, str(tmp_path)).collect()}
    encoder = dense.hashed_ngram_encoder()
    for i, t in enumerate(texts):
        t = t or ""
        mean = encoder([t[k : k + 640] for k in range(0, max(len(t), 1), 640)]).mean(axis=0)
        assert np.allclose(got[i], mean / max(np.linalg.norm(mean), 1e-6), atol=1e-6)
    assert not np.allclose(got[0], got[1])
    cut = {r["id"]: r["vec"] for r in dense.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    assert cut[0] == cut[1] == cut[5]
