"""Cases of the findings at larger tables: signs of rounded numbers, and steps that grew faster than their input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.functions import stem, text
from marlstone.operators import bm25, candidates, chargram, competitors, dense, history, location, pairs, prepare
from marlstone.plans import all_oracles, all_queries, rank_queries, sampling_queries, search_queries
from marlstone.sources import stages


def test_small_negative_numbers_round_as_in_sql(spark, tmp_path):
    """Differed before: 0.0 for -0.0."""
    path = f"{tmp_path}/embeddings.parquet"
    duckdb.execute(f"copy (select * from (values (0, 1, [1.0, -0.000001]::float[]), (1, 1, [1.0, 0.0]::float[]), (2, 2, [-0.00001, 0.0001]::float[])) t(vec_id, label, embedding)) to '{path}' (format parquet)")
    with duckdb.connect() as con:
        con.execute(f"create view embeddings as select * from '{path}'")
        for name in ("a6_vectors", "f2_mean_pool", "c5_dot"):
            df = all_queries()[name](spark, str(tmp_path))
            got = con.sql(all_oracles()[name])
            order = [got.columns.index(c) for c in df.columns]
            assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall()), name


def test_mean_vectors_of_null_labels_and_components_are_those_of_sql(spark, tmp_path):
    """Differed before: rows without a label gave a mean, and one null component in a mean spoilt the whole vector."""
    path = f"{tmp_path}/embeddings.parquet"
    duckdb.execute(f"copy (select * from (values (0, 1, [1.0, -0.5]::float[]), (1, null, [1.0, 0.0]::float[]), (2, 2, [null, 0.1]::float[]), (3, 2, [null, 3.0, 1.0]::float[]), (4, 3, null), (5, 4, [null, null]::float[]), (6, 5, []::float[]), (7, 6, [0, 0]::float[])) t(vec_id, label, embedding)) to '{path}' (format parquet)")
    with duckdb.connect() as con:
        con.execute(f"create view embeddings as select * from '{path}'")
        want = con.sql(all_oracles()["f2_mean_pool"]).fetchall()
    assert sorted(map(repr, map(tuple, all_queries()["f2_mean_pool"](spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_plain_answer_meets_each_query_with_no_more_items_than_it_answers(spark):
    """Before, every item of the query's location was a pair."""
    items = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("item_location_id"))
    first = rank_queries._first_items(items)
    assert first.count() == 3 * rank_queries.ANSWER
    assert {r["row_id"] for r in first.collect()} == set(range(3 * rank_queries.ANSWER))


def test_report_needs_no_search(spark, monkeypatch):
    """Before, the report of the folds made all lists and features."""
    monkeypatch.setattr(rank_queries.Search, "__init__", lambda *_: pytest.fail("the search was made"))
    monkeypatch.setattr(search_queries, "_made", {})
    assert all_queries()["a7_report_json"](spark, "/root/testdata/sf0.001").count() > 0


def test_history_meets_each_item_of_a_text_once(spark):
    """Before, an item chosen from 30 locations was 30 rows for every query near its text."""
    chosen = spark.createDataFrame([("a", 1, loc, 2) for loc in range(30)] + [("a", 2, None, 5), ("b", 1, 3, 1)], "text string, row_id long, loc int, c long")
    assert history.items_of_texts(chosen).count() == 3
    nb = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.9), ("r", "a", 0.1)], "qid string, text string, sim double")
    queries = spark.createDataFrame([("q", 0, "a", 3), ("r", 0, "a", 3)], "qid string, fold int, search_query string, search_location_id int")
    corpus = spark.createDataFrame([(1, True, None), (2, False, [0])], "row_id long, in_bench boolean, folds array<long>")
    got = {(r["qid"], r["row_id"]): tuple(r)[2:] for r in history.history_scores(nb, chosen, queries, corpus, 0.2).collect()}
    assert got == {("q", 1): (pytest.approx(0.5 * (2 + 58 * 0.3) + 0.9), 60.0, 2.0), ("q", 2): (pytest.approx(0.5 * 5 * 0.3), 5.0, 0.0)}


def test_block_lists_and_pair_scores_equal_those_of_the_index(spark):
    """The search had no such form before: every matching posting was a row for every query."""
    words = [f"w{k}" for k in range(9)]
    rows = [(r, " ".join(words[(r * k) % 9] for k in range(1, 4)), f"p{r % 4} x", " ".join(words[(r + k) % 9] for k in range(5)), r % 3, r % 5 != 0, [r % 2]) for r in range(60)]
    corpus = spark.createDataFrame(rows, "row_id long, title string, params string, description string, loc int, in_bench boolean, folds array<long>")
    texts = corpus.select("row_id", "title", "params", "description")
    chunks = stages.kept(bm25.in_chunks(corpus, F.col("loc"), 4))
    index = bm25.block_index(chunks)
    queries = spark.createDataFrame([(f"q{k}", k % 2, k % 4, f"{words[k % 9]} {words[(k * 2 + 1) % 9]} unknown", f"p{k % 5} x" if k % 3 else "") for k in range(12)], "qid string, fold int, search_location_id int, query string, filters string")
    terms = stages.kept(bm25.query_terms(queries, bm25.vocabulary(index)))
    listed = corpus.select("row_id", F.col("row_id").alias("base"), "in_bench", "folds", F.col("loc").alias("item_location_id"))
    trans = spark.createDataFrame([(0, 0, 5), (0, 1, 2), (1, 2, 4), (2, 2, 1)], "s int, l int, c long")
    totals = location.location_totals(trans)
    postings = stages.kept(bm25.bm25_postings(texts))
    places = corpus.select("row_id", F.lit(None).cast("long").alias("src_row"), "loc", "in_bench", "folds")
    want = candidates.bm25_lists(terms, index, queries, listed, chunks, trans, totals, 6, 4)
    got = candidates.bm25_block_lists(terms, postings, queries, places, trans, 6, 4, block=16)
    shape = lambda df: sorted((r["qid"], r["rank"], r["row_id"], round(r["score"], 8)) for r in df.select("qid", "rank", "row_id", "score").collect())
    for a, b in zip(got, want):
        assert shape(a) == shape(b)
    pairs = queries.select("qid").crossJoin(corpus.select("row_id"))
    filters = bm25.query_terms(queries, bm25.vocabulary(postings), False, (), "filters")
    found = {(r["qid"], r["row_id"]): r for r in bm25.pair_scores(pairs, terms, filters, postings).collect()}
    assert len(found) == 12 * 60
    for df, columns in ((bm25.bm25_combine(terms, postings), ("bm_t", "bm_p", "bm_d", "bm_comb")), (bm25.coverage(terms, postings), ("cov_t", "cov_any")), (bm25.filter_coverage(pairs, queries, postings, exclude=()), ("pcov",))):
        rest = set(found)
        for r in df.collect():
            rest.discard((r["qid"], r["row_id"]))
            assert [found[(r["qid"], r["row_id"])][c] for c in columns] == pytest.approx([r[c] for c in columns])
        assert all(found[k][c] == 0 for k in rest for c in columns)


def test_chargram_vectors_join_no_table_of_all_texts(spark):
    """Before, the lengths of all texts were a table of their own, joined and in places broadcast, and grams were shuffled to be counted."""
    df = spark.createDataFrame([(k, f"abc abcd {k % 3}xyz abc") for k in range(20)], "id long, t string")
    assert "Exchange" not in chargram.grams(df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    model = stages.kept(chargram.fit(df, "id", "t"))
    v = chargram.vectors(df, model, "id", "t")
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    norms = {r["id"]: r["n"] for r in v.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()}
    assert norms == {k: pytest.approx(1.0) for k in range(20)}


def test_exact_history_of_the_own_text(spark):
    """Before, j6 scored the items of all neighbours and dropped those of other texts afterwards."""
    chosen = spark.createDataFrame([("a", 1, 3, 2), ("b", 1, 3, 1), ("b", 2, 4, 7)], "text string, row_id long, loc int, c long")
    nb = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.5), ("r", "b", 0.9), ("t", "b", 0.1)], "qid string, text string, sim double")
    queries = spark.createDataFrame([("q", 0, "a", 3), ("r", 0, "b", 3), ("t", 0, "b", 3)], "qid string, fold int, search_query string, search_location_id int")
    corpus = spark.createDataFrame([(1, True, None), (2, True, None)], "row_id long, in_bench boolean, folds array<long>")
    want = history.history_scores(nb, chosen, queries, corpus, 0.2).where("hist_exact > 0").select("qid", "row_id", "hist_exact", "hist_exact_same")
    got = history.history_exact(nb, chosen, queries, corpus, 0.2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("q", 1, 2.0, 2.0), ("r", 1, 1.0, 1.0), ("r", 2, 7.0, 0.0)]


def test_sampled_texts_keep_no_choices(spark, monkeypatch):
    """Before, all choices were written, split and written again before the texts were sampled."""
    monkeypatch.setattr(search_queries, "_made", {})
    monkeypatch.setattr(prepare, "mark_held", lambda *_: pytest.fail("the choices were kept"))
    assert all_queries()["g2_sample_texts"](spark, "/root/testdata/sf0.001").count() > 0


def test_pairs_sort_and_keep_only_what_is_read(spark, monkeypatch):
    """Before, the steps on pairs carried all columns of a choice, and the first of them kept the capped pairs too."""
    monkeypatch.setattr(search_queries, "_made", {})
    made = sampling_queries.Pairs.of(spark, "/root/testdata/sf0.001")
    assert set(made.distinct.columns) == set(pairs.PAIR_COLUMNS) - {"search_infm_params_text"}
    assert "capped" not in made.__dict__


def test_nearest_are_searched_once_per_text_and_location(spark, monkeypatch):
    """Before, every pair was a query of its own."""
    asked = []
    monkeypatch.setattr(pairs, "block_topk", lambda q, *a, **b: asked.append(q.count()) or dense.block_topk(q, *a, **b))
    rows = [(f"k{k}", "a" if k < 8 else "b", 1000 + k, k % 2) for k in range(12)]
    given = spark.createDataFrame(rows, "row_key string, search_query string, row_id long, loc int")
    texts = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "search_query string, vec array<float>")
    items = spark.createDataFrame([(r, r % 2, [float(r), 20.0 - r]) for r in range(20)], "row_id long, loc int, vec array<float>")
    chosen = spark.createDataFrame([("a", 18), ("a", 19), ("b", 0)], "search_query string, row_id long")
    got = {r["row_key"]: r["neg"] for r in pairs.hard_negatives(given, texts, items, chosen, 1, 3).collect()}
    assert asked == [4] and set(got) == {f"k{k}" for k in range(12)}
    may = {("a", 0): {14, 12}, ("a", 1): {15, 13}, ("b", 0): {4, 6}, ("b", 1): {3, 5}}
    assert all(got[k] in may[(t, loc)] for k, t, _, loc in rows)


def test_threshold_deals_only_vectors_of_its_pairs(spark, monkeypatch):
    """Before, all items travelled once for every 512 of all queries."""
    dealt = []
    monkeypatch.setattr(competitors, "score_pairs", lambda p, q, i: dealt.append((q.count(), i.count())) or dense.score_pairs(p, q, i))
    queries = spark.createDataFrame([(f"q{k:02}", [f"i{k}"] if k < 9 else None) for k in range(30)], "qid string, rel array<string>")
    vectors = spark.createDataFrame([(f"q{k:02}", [1.0, float(k)]) for k in range(30)], "qid string, vec array<float>")
    corpus = spark.createDataFrame([(f"i{k}", k) for k in range(50)], "item_id string, row_id long")
    items = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(50)], "row_id long, vec array<float>")
    assert competitors.sim_threshold(queries, vectors, items, corpus, first=4).first()["threshold"] == 1.0
    assert dealt == [(4, 4)]


def test_counts_meet_items_of_the_named_locations_once_a_vector(spark, monkeypatch):
    """Before, every query met every item of every location, equal vectors one by one."""
    sizes = []
    deal = dense._dealt
    monkeypatch.setattr(dense, "_dealt", lambda q, i, block, by_location=False, run=1: sizes.append((q.count(), i.count(), by_location)) or deal(q, i, block, by_location, run))
    queries = spark.createDataFrame([(f"q{k}", [1.0, 0.0], k % 2, 2 if k < 5 else 9) for k in range(10)] + [("r", [0.0, 1.0], 1, 1)], "qid string, vec array<float>, own int, away int")
    items = spark.createDataFrame([(k, [1.0, 0.0] if k % 4 else [0.0, 1.0], k % 3) for k in range(60)], "row_id long, vec array<float>, loc int")
    got = {r["qid"]: (r["own"], r["away"]) for r in dense.count_similar(queries, items, 0.5, ["own", "away"], 2).collect()}
    near = lambda loc, want: sum(1 for k in range(60) if k % 3 == loc and bool(k % 4) == want)
    assert got == {f"q{k}": (near(k % 2, True), near(2, True) if k < 5 else 0) for k in range(10)} | {"r": (near(1, False), near(1, False))}
    assert sizes == [(5, 6, True)]


def test_many_slabs_of_items_give_k_rows_a_query(spark, monkeypatch):
    """Before, every block of items gave its k best of every query."""
    made = []
    by_blocks = dense._by_blocks
    monkeypatch.setattr(dense, "_by_blocks", lambda *a: made.append(by_blocks(*a)) or made[-1])
    queries = spark.createDataFrame([(f"q{k}", [float(k), 1.0], k % 3) for k in range(8)], "qid string, vec array<double>, loc int")
    items = spark.createDataFrame([(f"i{k:03}", [float(k * 37 % 101) / 7, float(k % 5)], k % 4) for k in range(120)], "row_id string, vec array<double>, loc int")
    got = sorted((r["qid"], r["rank"], r["row_id"], r["sim"]) for r in dense.block_topk(queries, items, 3, place="other", block=8).collect())
    want = []
    for q in queries.collect():
        best = sorted((-round(sum(x * y for x, y in zip(q["vec"], i["vec"])), 6), i["row_id"]) for i in items.collect() if i["loc"] != q["loc"])[:3]
        want += [(q["qid"], n + 1, row, -s) for n, (s, row) in enumerate(best)]
    assert got == [(a, b, c, pytest.approx(d)) for a, b, c, d in sorted(want)]
    assert made[0].count() <= 8 * 3 * max(4, 120 // (8 * dense.RUN) + 1)


def test_sums_over_blocks_equal_those_of_all_postings(spark):
    """Before, the whole index was made for the terms of a few queries, and every matching posting was a row."""
    words = [f"w{k}" for k in range(9)]
    corpus = spark.createDataFrame([(r, " ".join(words[(r * k) % 9] for k in range(1, 4)), f"p{r % 4} x", " ".join(words[(r + k) % 9] for k in range(r % 6))) for r in range(40)], "row_id long, title string, params string, description string")
    queries = spark.createDataFrame([(k, f"{words[k]} {words[(k * 2 + 1) % 9]} unknown") for k in range(4)], "qid long, query string")
    whole = stages.kept(bm25.bm25_postings(corpus))
    terms = stages.kept(bm25.query_terms(queries, bm25.vocabulary(whole)))
    asked = stages.kept(bm25.asked_terms(corpus, spark.createDataFrame([(w,) for w in (*words[:6], words[7], "unknown")], "term string")))
    names = {r["term"] for r in asked.collect()}
    assert not any(set(n.split("§")) & {words[6], words[8], "x"} for n in names)
    shape = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert shape(bm25.asked_postings(asked, corpus)) == shape(whole.where(F.col("term").isin(list(names))))
    pairs = stages.kept(bm25.pair_sums(terms, bm25.asked_postings(asked, corpus)))
    assert shape(bm25.query_terms(queries, asked.select("term").distinct())) == shape(terms)
    assert shape(bm25.summed_scores(pairs).select("qid", "row_id", "field", "score")) == shape(bm25.bm25_scores(terms, whole))
    assert shape(bm25.summed_combine(pairs)) == shape(bm25.bm25_combine(terms, whole))
    assert shape(bm25.summed_coverage(pairs)) == shape(bm25.coverage(terms, whole))


ODD = ["", None, "  ", "_a_B1 Ё-ёж ЯБЛОКО\u0450\u042f\u0451x", "İstanbul \u212a Straße é1\u00e92", "the tests were testing tested things and things", "и в на", "z{`@[/:a9", "a\u2028b\t😀c", "бегущие бегали running runs"]


def _odd_documents(spark, path, ids):
    rows = [(i, t, "en", "s") for i, t in zip(ids, ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")


def _sql(path, name):
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
        got = con.sql(all_oracles()[name])
        return got.columns, got.fetchall()


@pytest.mark.parametrize("name", ["b1_normalize", "b2_tokens", "b3_drop_stop", "b5_bigrams", "d4_bm25_postings"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    """Repeated and null ids too, where they leave SQL no choice of order. One letter differed before."""
    _odd_documents(spark, tmp_path, range(len(ODD)) if name in ("b5_bigrams", "d4_bm25_postings") else [0, 1, 2, 3, 3, 5, None, None, 3, 9])
    columns, want = _sql(tmp_path, name)
    df = all_queries()[name](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_separators_are_no_class_of_three_ranges(spark):
    """Before, Java took seven times as long over the class of the separators."""
    plan = spark.range(1).select(text.normalize(F.lit("a").cast("string"))).limit(1)._jdf.queryExecution().analyzed().toString()
    assert "p{Alnum}" in plan and "a-z" not in plan


def test_token_counts_make_no_row_per_token(spark, tmp_path):
    """Before, every token was a row, sorted by document to find the least."""
    _odd_documents(spark, tmp_path, range(len(ODD)))
    for name in ("b2_tokens", "b3_drop_stop"):
        assert "Generate" not in all_queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("ids", [range(len(ODD)), [0, 1, 2, 3, 3, 5, None, None, 5, 9]])
def test_stems_are_told_apart_inside_rows(spark, tmp_path, ids):
    """Before, every token was shuffled to meet its stem, and again to its document."""
    _odd_documents(spark, tmp_path, ids)
    got = all_queries()["b4_stem_tokens"](spark, str(tmp_path))
    tok = stem.snowball(text.drop_stop(text.tokens(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text")))
    want = tok.groupBy("doc_id").agg(F.count_distinct("term").alias("n_stems"), F.min("term").alias("first_stem"))
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    if None not in list(ids):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_terms_are_counted_by_as_many_tasks_as_are_asked_for(spark):
    """Before, the number of tasks did not grow with the table, and a task that read texts held a table of its pairs."""
    rows = spark.createDataFrame([(["a", "b", "a"],), (["b"],), ([],)], "terms array<string>")
    got = text.term_counts(rows, "terms", 13)
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("b", 2)}
    assert got.rdd.getNumPartitions() == 13
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Aggregate" not in plan[plan.index("Exchange") :]


def test_postings_pass_by_the_frequencies_unsorted(spark):
    """Before, all postings were sorted by term to meet the frequencies."""
    corpus = spark.createDataFrame([(k, f"a b{k % 3} c", "p", f"x y{k % 5} x") for k in range(40)], "row_id long, title string, params string, description string")
    want = bm25.bm25_postings(corpus)
    got = bm25.bm25_postings(corpus, tasks=5)
    assert "ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    shape = lambda df: sorted((*tuple(r)[:4], round(r["w"], 9)) for r in df.collect())
    assert shape(got) == shape(want)


def test_encoder_hashes_the_grams_of_a_batch_together(monkeypatch):
    """Before, each n-gram was hashed by a call of its own."""
    import zlib

    import numpy as np

    calls, crc32 = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda b: calls.append(b) or crc32(b))
    texts = [t or "" for t in ODD] + ["ab", "ü" * 700, "漢字かな" * 300]
    got = dense.hashed_ngram_encoder()(texts)
    assert len(calls) < 600
    want = np.zeros((len(texts), 64), np.float32)
    for i, t in enumerate(texts):
        for k in range(max(1, len(t) - 2)):
            h = crc32(t[k : k + 3].encode())
            want[i, h % 64] += 1 if h >> 31 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-6)
    assert got.tobytes() == want.tobytes()
