"""Fill-in-middle, repeated strings and vector codes against brute force, DuckDB and awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import infilling, mixing, queries, repeats, simhash, toxicity, vector_codes

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n\t ", "one", "a<S>b", "<", "é漢字 ß\x00x\r\n", "x" * 70_000, "word, " * 30_000, "Same text", "Same text"]
EXTRA = ("n", "Form", "output", "spans", "kept", "bucket", "a.b")


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "doc_id long, text string").withColumns({k: F.lit("x") for k in EXTRA})


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_vector_code_compression"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.fetchall())


# --- fill in middle ---


def middle(doc_id, text, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_middles_of_awkward_texts(spark):
    rng = random.Random(5)
    texts = AWKWARD + ["".join(rng.choice(["ab", "<", ">", "S", "é", " ", "\n", "Zz9"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    ids = [None, None] + list(range(len(texts) - 2))
    made = infilling.fill_in_middle(docs_of(spark, texts, ids))
    assert {c.lower() for c in made.columns} >= {"a.b", "spans", "segments"} and sum(c.lower() == "n" for c in made.columns) == 1
    rows = made.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in rows)
    assert got == Counter((i, *middle(i, t)) for i, t in zip(ids, texts))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(docs_of(spark, AWKWARD).limit(0)).collect() == []


@pytest.mark.parametrize("bound", [1, 7, 100])
def test_index_gives_every_offset(bound):
    rng = np.random.default_rng(bound)
    for n in (1, 2, 300, 20_000):
        offsets = np.cumsum(rng.choice([1, 1, 5, 9, 40, 3000], n, p=[0.3, 0.3, 0.2, 0.1, 0.09, 0.01])).astype(np.int64)
        index = infilling.RankIndex(offsets, bound)
        assert (index.offset(np.arange(n)) == offsets).all() and np.abs(index.residual).max() <= bound
    even = infilling.RankIndex(np.arange(0, 50_000, 5), bound)
    assert len(even.first) == 1


# --- repeated strings ---


def without_repeats(texts, span):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for t in data:
        seen.update(t[i : i + span] for i in range(len(t) - span + 1))
    out = []
    for t in data:
        gone, spans = np.zeros(len(t) + 1, bool), []
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int)]))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        left = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), len(spans), hashlib.sha256(left).hexdigest(), spans, left))
    return out


def repeating_texts(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(8))) for _ in range(n)]
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    near = [base[:i] + rng.choice("XYZ") + base[i + 1 :] for i in (rng.randrange(300) for _ in range(25))]
    return texts + near + [base, base, None, "", "aaaa" * 50, "ab" * 100, texts[0]]


@pytest.mark.parametrize("span,limit", [(20, 512), (20, 1), (9, 3), (70, 4), (3, 512)])
def test_repeats_equal_brute_force(spark, span, limit):
    texts = repeating_texts(span + limit)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs_of(spark, texts).repartition(5), span=span, limit=limit, content=True).collect()}
    for i, (n, removed, spans, sha, ranges, left) in enumerate(without_repeats(texts, span)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, sha)
        assert removed == 0 or ([(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) == (ranges, left)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    texts = repeating_texts(3, 10)
    monkeypatch.setattr(repeats, "SORTED", 100)
    want = without_repeats(texts, 20)
    hashes = repeats.GramHashes(10)
    for t in texts:
        t = (t or "").encode()
        if len(t) >= 20:
            which, lo, hi, _, _ = repeats.anchors([t[i : i + 83] for i in range(0, len(t) - 19, 64)], 20, hashes)
            starts = sorted(s + 64 * w for w, a, b in zip(which, lo, hi) for s in range(a, b + 1))
            assert starts == list(range(len(t) - 19))
    got = {r["doc_id"]: r["kept_sha256"] for r in repeats.remove_repeats(docs_of(spark, texts), span=20).collect()}
    assert got == {i: w[3] for i, w in enumerate(want)}


def test_repeats_of_awkward_rows(spark):
    texts = AWKWARD + ["z" * 199, "y" * 200, "v" * 201]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs_of(spark, texts, [None, 3, 3] + list(range(3, len(texts))))).collect())
    assert len(got) == len(texts)
    by_size = {n: (removed, spans) for _, _, n, removed, spans in got}
    assert by_size[70_000] == (70_000, 1) and by_size[180_000] == (180_000, 1) and by_size[199] == (0, 0) and by_size[200] == (0, 0) and by_size[201] == (201, 1)
    assert repeats.remove_repeats(docs_of(spark, texts).limit(0)).collect() == []


def test_pointers_settle_all_depths():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, 4000).astype(np.uint8)
    for span in (5, 8, 13, 40):
        ends = np.array([1000, 1500, 1510, 4000])
        room = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(4000)
        count = Counter(x[i : i + span].tobytes() for i in range(4000) if room[i] >= span)
        want = [i for i in range(4000) if room[i] >= span and count[x[i : i + span].tobytes()] > 1]
        assert sorted(repeats.repeated(x, room, span).tolist()) == want


# --- vector codes ---


def codes_of(rows, parts, entries, rounds):
    """By brute force over Python's whole numbers."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v) and len(v) == len(rows[0][1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(r[1], p) for r in good[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            to = defaultdict(list)
            for r in good:
                to[near(cut(r[1], p), books[p])[1]].append(cut(r[1], p))
            for k, xs in to.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out, by = [], Counter()
    for i, v, lab in good:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), lab))
        by[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, c, e, by[lab], sha) for i, c, e, lab in out)


@pytest.mark.parametrize("entries", [1, 8, 64])
def test_codes_equal_brute_force(spark, entries):
    rng = np.random.default_rng(entries)
    rows = [(i, [float(x) for x in np.round(v, 2)], rng.choice([None, "a", "b"])) for i, v in enumerate(rng.normal(size=(150, 8)))]
    rows += [(5, rows[7][1], None), (5, rows[7][1], None), (None, rows[9][1], "c"), (900, None, "a"), (901, [], "a"), (902, [1.0] * 7 + [float("nan")], "b"), (903, [1.0] * 7 + [None], "b"), (904, [float("inf")] * 8, "b"), (905, [1.0] * 4, "b"), (906, [0.5] * 6, "b")]
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label string, code string, error int").repartition(3)
    got = Counter(tuple(r) for r in vector_codes.compress(df, parts=4, entries=entries).collect())
    assert got == codes_of(rows, 4, entries, 2)
    assert vector_codes.compress(df.limit(0)).collect() == [] and vector_codes.compress(df.where("vec_id > 899")).collect() == []


def test_memo_leaves_out_only_what_is_dominated():
    rng = np.random.default_rng(4)
    entries = rng.integers(-100, 100, (64, 4))
    entries[5] = entries[9]
    x = rng.integers(-200, 200, (3000, 4))
    apart = ((x[:, None] - entries) ** 2).sum(2)
    for side, limit in ((1, 100), (16, 50), (64, 1 << 15)):
        memo = vector_codes.CellMemo(entries, side, limit)
        for i in range(0, 3000, 500):
            entry, least = memo.nearest(x[i : i + 500])
            assert (entry == apart[i : i + 500].argmin(1)).all() and (least == apart[i : i + 500].min(1)).all()
        assert len(memo.rows) <= max(limit, 500)
    again = vector_codes.CellMemo(entries)
    again.nearest(x)
    opened = again.opened
    again.nearest(x)
    assert again.opened == opened and again.evaluated < 0.5 * 2 * apart.size


# --- columns of maps, rows that repeat ---


def test_rows_that_differ_only_in_maps_stay(spark):
    text = "eight different words stand in this short text"
    kinds = "doc_id long, text string, source string, n_chars long, m map<string,int>, s struct<m: map<string,int>, x: int>, a array<map<string,int>>"
    rows = [(1, text, "a", 40, {"u": 1}, None, None), (1, text, "a", 40, {"u": 2}, None, None), (1, text, "a", 40, {"u": 1}, ({"v": 1}, 1), None), (1, text, "a", 40, {"u": 1}, ({"v": 2}, 1), None), (1, text, "a", 40, {"u": 1}, None, [{"w": 1}]), (1, text, "a", 40, {"u": 1}, None, [{"w": 2}, None]), (1, text, "a", 40, None, None, [])]
    df = spark.createDataFrame(rows, kinds)
    mixed = mixing.mixed_documents(df, most=2.0, share=2.0).collect()
    assert {repr((r["m"], r["s"], r["a"])) for r in mixed} == {repr((r["m"], r["s"], r["a"])) for r in df.collect()}
    one = {repr(simhash.one_per_group(df.repartition(k)).collect()) for k in (1, 3, 7)}
    assert len(one) == 1 and len(simhash.one_per_group(df).collect()) == 1
    two = spark.createDataFrame([(1, text, "a", 40, {"u": 1, "v": 2}, None, None), (1, text, "a", 40, {"v": 2, "u": 1}, None, None)], kinds)
    assert two.select(simhash.row_hash(two).alias("h")).distinct().count() == 1


def test_equal_rows_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 20_000)
    docs = spark.createDataFrame([(1, "words " * 200)] * 400, "doc_id long, text string")
    counts = toxicity.kept
    seen = []
    monkeypatch.setattr(toxicity, "kept", lambda df, name: seen.append(counts(df, name)) or seen[-1])
    from pyspark.sql import types as T

    ratios = spark.createDataFrame([], "gram long, m0 int, m1 int, m2 int")
    out = toxicity.joined(docs, ratios, [T.StructField("f", T.DoubleType())], lambda x: [x[:, 0]])
    assert out.count() == 400
    per = [r["count"] for r in seen[0].groupBy("chunk").count().collect()]
    assert len(per) > 15 and max(per) < 60
