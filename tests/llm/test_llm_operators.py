"""The operators against brute force, round trips, held-out accuracy, and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import bpe, chat, labelled, lattice, mixing, quality, queries, repetition, sharding, simhash, toxicity, urls
from marlstone.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, FP int"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " \n\t ", "one", "two words", "a b c a b c a b c", "Same text here today", "Same text here today", "x" * 70_000, "word " * 30_000, "é\x1cü 漢字 ##$$ <|endoftext|> \\### </turn>"]


def union_find(n, pairs):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


# --- 1 chat formatting ---


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["\\", "### ", "</turn>", "<|", "|>", "\n", ":", "x", "<", ">", "|", "#", " "]) for _ in range(rng.randrange(14)))
        assert chat.unescape(chat.escape(t)) == t
        seg = chat.format_turn("us:\ner" + t[:3], [{"type": "text", "text": t}], frozenset())["segment"]
        assert list(chat.read_turns(seg * 2)) == [("us:\ner" + t[:3], t)] * 2


def test_visitor_records_attachments_in_order():
    v = chat.Visitor()
    for p in ({"type": "text", "text": "see <|image:0|> "}, {"type": "image", "text": None, "ref": "a.png", "units": 4}, {"type": "audio", "text": None, "ref": "b.wav", "units": 3}, {"type": "document", "text": None, "ref": None, "units": None}, {"type": None, "text": "end"}):
        v.visit(p)
    assert "".join(v.out) == "see \\<|image:0\\|> <|image:0|><|audio:1|><|document:2|>end"
    assert [(a["ref"], a["tokens"]) for a in v.attachments] == [("a.png", 1024), ("b.wav", 75), ("", 600)]


def test_conversation_digests(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi\n", "\\### x </turn>", "é|>"])) for c in (1, 2, None) for t in range(200 if c == 1 else 3)]
    shown = rows[:]
    rng.shuffle(shown)
    df = spark.createDataFrame(shown, "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(F.col("text"))).repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.conversations(df)).collect()}
    assert set(got) == {1, 2, None}
    for c, r in got.items():
        mine = sorted([x for x in rows if x[0] == c], key=lambda x: x[1])
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.conversations(df.limit(0))).collect() == []


def test_attachments_are_numbered_over_the_conversation(spark):
    rng = random.Random(17)
    kinds = ["image", "audio", "document", "text", None, "video"]
    rows = []
    for conv, turn in [(1, t) for t in range(150)] + [(2, None)] * 60 + [(3, 5)] * 60 + [(None, 0), (4, 1)]:
        parts = [None if rng.random() < 0.1 else (rng.choice(kinds), rng.choice([None, "", "t <|image:0|>"]), f"r{rng.random()}", rng.choice([None, 0, 3])) for _ in range(rng.randrange(4))]
        rows.append((conv, turn, "assistant", None if rng.random() < 0.1 else parts, "x"))
    rows += [(5, 1, "user", [("image", None, "same", 1)], "x")] * 40
    df = spark.createDataFrame(rows, T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.ArrayType(chat.PART)), T.StructField("range", T.StringType())])).repartition(5)
    chunks = chat.conversations(df, chunk=500).collect()
    by = defaultdict(list)
    for r in sorted(chunks, key=lambda r: r["chunk"]):
        by[r["conv_id"]].append(r)
    assert len(by[1]) > 3 and len(by[2]) > 1 and len(by[3]) > 1
    for conv, strings in by.items():
        want = Counter((p[0], p[2], chat.EXPANSION[p[0]] * max(1, p[3] or 1)) for c, _, _, parts, _ in rows if c == conv for p in parts or () if p and p[0] in chat.EXPANSION)
        files = [a for r in strings for a in r["attachments"]]
        assert [a["place"] for a in files] == list(range(len(files)))
        assert Counter((a["type"], a["ref"], a["tokens"]) for a in files) == want
        marks = re.findall(r"(?<!\\)<\|(\w+):(\d+)\|>", "".join(r["formatted"] for r in strings))
        assert marks == [(a["type"], str(a["place"])) for a in files]
        assert sum(len(list(chat.read_turns(r["formatted"]))) for r in strings) == sum(c == conv for c, *_ in rows)


def test_attachments_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    for name in ("chat_attachments", "op1_chat_formatting"):
        rows = queries.QUERIES[name](spark, SF)
        cols = sorted(rows.columns)
        got = con.execute(queries.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        assert sorted(tuple(r[c] for c in cols) for r in rows.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in got.fetchall())


# --- 2 SimHash ---


def brute_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = words.encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_equal_brute_force(spark):
    base = queries.read(spark, SF, "documents").select("doc_id", "text").collect()
    texts = [r["text"] for r in base] + AWKWARD
    want = [brute_fingerprint(t) for t in texts]
    comp = union_find(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (want[a] ^ want[b]).bit_count() <= 3])
    for cap in (32_768, 3):
        got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts), cap=cap).collect()}
        assert [got[i]["fp"] & (1 << 64) - 1 for i in range(len(texts))] == want
        assert [got[i]["component_id"] for i in range(len(texts))] == comp


def test_fingerprint_links_on_tight_groups(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(60)})
    want = union_find(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for cap in (10_000, 25):
        got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(df, cap=cap)).collect()}
        mine = [got.get(f, f) for f in signed]
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_fingerprint_links_with_other_limits(spark):
    rng = random.Random(13)
    fps = list({rng.getrandbits(64) & 0xFF00FF00FF ^ rng.getrandbits(64) & rng.getrandbits(64) & 7 for _ in range(120)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bits in (0, 1, 2, 5):
        want = union_find(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= bits])
        got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(df, bits=bits, cap=30)).collect()}
        mine = [got.get(f, f) for f in fps]
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_gray_index_finds_all_within():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    q = x[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    index = simhash.GrayIndex(x)
    a, b = index.within(q)
    assert index.pruned > 0.4 * index.visited
    near = np.bitwise_count(q[:, None] ^ x) <= 3
    assert {(i, j) for i, j in zip(a, b)} == {(i, j) for i, j in zip(*np.nonzero(near))}
    index, head = simhash.GrayIndex(x), 0xFFFF << 48
    a, b = index.within(q, head=head)
    same = (q[:, None] ^ x) & np.uint64(head) == 0
    assert {(i, j) for i, j in zip(a, b)} == {(i, j) for i, j in zip(*np.nonzero(near & same))} and index.visited < 60 * len(q)


def test_one_per_group_keeps_every_text(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "zz yy xx ww", "x"), (2, "a b c d", "y"), (3, "quite another text", None), (None, "a b c d", "x"), (None, "no id here", "x"), (None, "no id here", "x"), (4, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("`odd name`", F.lit(1)).withColumn("d", F.array(F.lit(1)))
    got = simhash.one_per_group(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == [(-1, "no id here"), (1, "a b c d"), (1, "zz yy xx ww"), (3, "quite another text"), (4, None)]
    assert simhash.one_per_group(df.limit(0)).collect() == []
    ids = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert ids == {(1, 1), (2, 1), (3, 3), (None, 1), (None, None), (4, 4), (5, 4)}


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


# --- 3 lattice hashing ---


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(5)
    y = rng.normal(size=(300, 8)) * 2
    p = lattice.decode_e8(y) / 2
    near = lattice.e8_neighbours() / 2
    assert len(near) == 240 and np.allclose((near**2).sum(axis=1), 2)
    d = ((y - p) ** 2).sum(axis=1)
    assert (d[:, None] <= ((y[:, None] - p[:, None] - near) ** 2).sum(axis=2) + 1e-9).all() and (d <= 1 + 1e-9).all()


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(150, 16))
    x = np.concatenate([centres + s * rng.normal(size=centres.shape) for s in (0, 0.05, 0.1, 0.2)]).astype(np.float32)
    x = np.concatenate([x, x[:40], x[:1] * 3, centres[:1] + 0.02 * rng.normal(size=(60, 16))]).astype(np.float32)
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15]
    rows = [(i, v, 1) for i, v in enumerate([*x.tolist(), *bad])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    for cap in (4096, 7):
        got = {r["vec_id"]: r for r in lattice.near_duplicates(df, cap=cap).collect()}
        assert len(got) == len(rows)
        n = np.array([got[i]["n_links"] for i in range(len(x))])
        assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.97 * near.sum()
        for i in range(len(x), len(rows)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
        for i in range(len(x)):
            assert got[i]["kept"] == (got[i]["component_id"] == i) and got[i]["component_id"] <= i
    assert lattice.near_duplicates(df.limit(0)).collect() == []


def test_vectors_of_several_lengths_and_null_ids(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.1]), (4, [3.0, -1.0, 0.0])]
    rows += [(10 + i, [float(i == j) for j in range(8)]) for i in range(5)] + [(20, [5.0]), (21, [7.0]), (22, [-7.0])]
    rows += [(None, [1.0, 2.0, 2.9]), (None, [0.0, 0.0, 1.0, 1.0]), (None, [0.0, 0.1, 1.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("x"))
    got = [tuple(r) for r in lattice.near_duplicates(df).collect()]
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True)] + [(10 + i, 0, 10 + i, True) for i in range(5)]
    want += [(20, 1, 20, True), (21, 1, 20, False), (22, 0, 22, True), (None, 3, 1, False), (None, 1, None, False), (None, 1, None, False), (None, 0, None, False)]
    assert Counter(got) == Counter(want)


def test_recall_and_precision_near_the_limit(spark):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.r_[np.full(600, 0.9003), np.full(300, 0.8997), rng.uniform(0.85, 0.99, 600)][:, None]
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * z]).astype(np.float32)
    u = both.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(both.tolist())], "vec_id long, embedding array<float>")
    n = np.zeros(len(both), int)
    for r in lattice.near_duplicates(df).collect():
        n[r["vec_id"]] = r["n_links"]
    assert (n <= near.sum(axis=1)).all() and near.sum() > 1600
    assert n.sum() >= 0.95 * near.sum()


# --- 4 BPE ---


def test_codec_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    theirs = Tokenizer.from_file(path)
    rng = random.Random(7)
    alphabet = list("ab \n\t'sé \x1c\x85١2​漢\U0001f600́xX.,!  ") + ["<|endoftext|>", "'ll", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)] + AWKWARD + [r["text"] for r in queries.read(spark, SF, "documents").limit(60).collect()]
    got = {r["doc_id"]: r for r in bpe.round_trip(docs_of(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        back = theirs.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    some = bpe.decode(bpe.encode(docs_of(spark, texts[:50]), path), path).select("text", "decoded").collect()
    assert all(r["decoded"] == r["text"] for r in some)


def test_other_tokenizer_settings_are_refused(tmp_path):
    import json

    spec = json.load(open(queries.tokenizer_path()))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": None}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"model": spec["model"] | {"ignore_merges": True}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary.load(str(path))


# --- 5 repetition ---


def brute_repeats(s):
    n = len(s)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and s[i + k] == s[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_longest_repeats_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        s = np.array([rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(40))], np.int64)
        assert repetition.longest_repeats(s).tolist() == brute_repeats(s.tolist())


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(9)
    texts = AWKWARD[:8] + [" ".join(rng.choice("abcdefgh") + rng.choice(["", "", "\n", " #"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    for r in repetition.judge(docs_of(spark, texts), min_repeat=4).collect():
        t = texts[r["doc_id"]] or ""
        words, best = t.split(), brute_repeats(t.split())
        cover = lambda least, most=10**9: sum(any(best[s] >= least and s + min(best[s], most) > i for s in range(i + 1)) for i in range(len(words)))
        lines = [x for x in t.split("\n") if x.strip()]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == cover(3, 3) and r["covered_words"] == cover(4) and r["longest_repeat"] == max(best, default=0)
    long = repetition.judge(docs_of(spark, AWKWARD)).collect()
    assert {r["doc_id"]: r["longest_repeat"] for r in long}[9] == 29_999
    assert repetition.judge(docs_of(spark, AWKWARD).limit(0)).collect() == []


# --- 6 mixing ---


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] / total * left >= 2 * sizes[s]]
        if not over:
            return out | {s: w[s] / total * left for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 11))
        assert sorted(p.tolist()) == list(range(n))
    assert not np.array_equal(mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)), mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2)))


def test_mix_meets_targets(spark):
    rng = random.Random(10)
    sources = [rng.choice(["a", "a", "a", "b", "c", "d", "", "ä", None]) for _ in range(400)]
    texts = [rng.choice([None, "", " ".join(["w"] * rng.randrange(400))]) if i % 5 == 0 else " ".join(["w"] * rng.randrange(400)) for i in range(400)]
    df = docs_of(spark, texts, sources)
    rows = sorted(mixing.mix(df).collect())
    assert len(rows) == 400 and rows == sorted(mixing.mix(df).collect())
    sizes = defaultdict(int)
    for s, t in zip(sources, texts):
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), Counter()
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    mixed = mixing.mixed_documents(df).collect()
    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert all(words[r["doc_id"]] == r["taken"] for r in rows)
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mixed_documents(df.limit(0)).collect() == []


def test_mix_shards_have_one_length(spark):
    targets = spark.createDataFrame([(0, 6400 * 50, 6400 * 70.0), (1, 6400 * 9, 6400 * 18.0), (2, 640, 1000.0), (3, 0, 0.0)], "sid int, source_size long, target double")
    rows = mixing.slots(targets, block=64, shard=500).collect()
    need = {0: 7000, 1: 1800, 2: 16}
    length = Counter(r["shard"] for r in rows)
    assert [length[i] for i in sorted(length)] == [500] * 17 + [316]
    for sid, n in need.items():
        mine = [r for r in rows if r["sid"] == sid]
        assert sorted(r["k"] for r in mine) == list(range(n))
        times = Counter(r["block"] for r in mine)
        assert max(times.values()) - min(times.values()) <= 1 and max(times.values()) <= 2
    assert Counter(mixing.slots(targets, 64, 500, most=1).groupBy("sid", "block").count().select("count").toPandas()["count"]) == Counter({1: 5000 + 900 + 10})


def test_running_total_equals_loop(spark):
    rng = random.Random(18)
    rows = [(s, i, rng.randrange(9)) for s in "ab" for i in rng.sample(range(500), 80)]
    got = {(r["s"], r["i"]): r["t"] for r in mixing.running_total(spark.createDataFrame(rows, "s string, i long, v long"), ["s"], "i", "v", "t", 7).collect()}
    assert got == {(s, i): sum(w for q, j, w in rows if q == s and j < i) for s, i, _ in rows}


def test_mix_with_repeated_ids(spark):
    many = spark.createDataFrame([(7, "one two three", "s")] * 90 + [(None, f"w{i} x", None) for i in range(30)], "doc_id long, text string, source string")
    rows = mixing.mix(many, block=2, shard=16).collect()
    assert len(rows) == 120 and sum(r["taken"] for r in rows) == sum(len(r["text"].split()) for r in mixing.mixed_documents(many, block=2, shard=16).collect())
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None), (None, "d e", "s")], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 4 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(len(r["text"].split()) for r in mixing.mixed_documents(df).collect()) == sum(r["taken"] for r in rows)


# --- 7, 8 classifiers ---


def accuracy(spark, rows, label):
    truth = {r["doc_id"]: r[label] for r in queries.read(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.mean([a == b for a, b in held])


@pytest.mark.parametrize(("module", "query", "label", "modulus", "rest"), [(toxicity, queries.op7_toxicity, "toxic", 4, 2), (quality, queries.op8_quality_classifier, "quality", 5, 0)])
def test_classifiers(spark, module, query, label, modulus, rest):
    rows = query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    assert accuracy(spark, rows, label) >= 0.9
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    awkward = module.predictions(docs_of(spark, AWKWARD), labels).collect()
    assert len(awkward) == len(AWKWARD)
    assert len(module.predictions(docs_of(spark, AWKWARD), labels.limit(0)).collect()) == len(AWKWARD)
    assert module.predictions(docs_of(spark, AWKWARD).limit(0), labels).collect() == []


def test_quality_features_equal_brute_force():
    import zstandard as zstd

    rng = random.Random(15)
    make = lambda alphabet, n: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(n)).encode()
    dictionaries = [make("abcd", 300), make("wxyz", 300)]
    model = quality.Compressors(*dictionaries)
    for text in (make("abcdwxyz", 1), make("abcd", 3000), make("wxyz", 345), b"x" * 100_000):
        n = max(1, (len(text) + 1024) // 2048)
        pieces = [text[i * 2048 : (i + 1) * 2048 if i < n - 1 else len(text)] for i in range(n)]
        assert b"".join(pieces) == text and quality.cut(text) == pieces
        sizes = np.array([[len(zstd.ZstdCompressor(level=quality.LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(p)) for p in pieces] for d in dictionaries])
        diff = (sizes[0] - sizes[1]) / sizes.sum(axis=0)
        want = ((sizes[0] - sizes[1]).sum() / sizes.sum(), diff.max(), diff.min(), sizes.min(axis=0).sum() / len(text))
        # A dictionary prepared beforehand may choose other matches: sizes differ by a few bytes.
        assert np.allclose(model.features(text), want, atol=0.05)
    assert model.features(dictionaries[0][:1500])[0] < -0.1 < 0.1 < model.features(dictionaries[1][:1500])[0]
    assert model.features(b"") == (0.0,) * 4


def test_quality_learns_from_whole_documents_up_to_a_bound(spark):
    rows = [(i, f"word{i} " * (20 + i % 7) if i % 50 else "long " * 2000, i % 2, i // 2 % 2) for i in range(400)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int, fold int")
    most, texts = 20_000, {t.encode(): y for _, t, y, _ in rows}
    got = quality._pieces(sample, most).collect()
    for label in (0, 1):
        drawn = [bytes(r["piece"]) for r in got if r["label"] == label]
        assert most <= sum(map(len, drawn)) < most + most // 16
        assert all(texts.get(p) == label for p in drawn)
    everything = quality._pieces(sample, 1 << 30).collect()
    assert sum(len(r["piece"]) for r in everything) == sum(len(t.encode()) for _, t, _, _ in rows)
    assert {(r["label"], r["fold"]) for r in everything} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_calibration_equals_gradient_zero():
    rng = np.random.default_rng(16)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + rng.normal(size=400) > 0.5).astype(int)
    model = labelled.Logistic(x, y, y.mean())
    z = np.c_[(x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), np.ones(400)]
    pull = np.r_[np.full(2, 0.02 * 20), 1e-6]
    assert np.abs(z.T @ (model(x) - y) + pull * np.r_[model.w[:-1], 0]).max() < 1e-3
    assert ((model(x) > 0.5) == y).mean() > 0.7


def grams_of(text):
    return toxicity.word_grams(toxicity.words_of((text or "").encode()))[0].tolist()


def test_word_grams_equal_brute_force():
    text = "Été a1b22 x-y longerwordthanorder q"
    words = toxicity.words_of(text.encode())
    want = []
    for w in words:
        symbols = [int(toxicity.SYMBOL[b]) for b in w] + [0]
        for i in range(len(symbols)):
            last = ([0] * toxicity.ORDER + symbols[: i + 1])[-toxicity.ORDER :]
            want.append(sum(x << toxicity.BITS * k for k, x in enumerate(reversed(last))))
    gram, letters = toxicity.word_grams(words)
    assert gram.tolist() == want and letters.tolist() == [len(w) for w in words]
    assert toxicity.word_grams([])[0].tolist() == []


def test_toxicity_ratios_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 11))) for _ in range(20)) for _ in range(30)] + [None, "", "rarest zq"]
    rows = [(t, int(i % 3 == 0), i % 2) for i, t in enumerate(texts)]
    counts = toxicity.gram_counts(spark.createDataFrame(rows, "text string, label int, fold int"))
    n = {m: (Counter(), Counter()) for m in (0, 1, 2)}
    for t, label, fold in rows:
        for m in (fold, 2):
            n[m][label].update(grams_of(t))
    got = {r["gram"]: tuple(r[c] for c in toxicity.COUNTS) for r in counts.collect()}
    assert got == {g: tuple(n[k][y][g] for k in (0, 1) for y in (0, 1)) for g in n[2][0] | n[2][1]}
    bits, low = toxicity.BITS, lambda k: (1 << toxicity.BITS * k) - 1
    symbols = sorted({g & low(1) for g in n[2][0] | n[2][1]})

    def continuations(grams):
        sets = {toxicity.ORDER: set(grams)}
        for k in range(toxicity.ORDER - 1, 0, -1):
            sets[k] = {g & low(k) for g in sets[k + 1]}
        return {k: Counter(g & low(k) for g in sets[k + 1]) for k in range(1, toxicity.ORDER)}

    def shared(g, k):
        g &= low(k)
        if k == 1:
            return max(cont[1][g], 1e-6) / sum(cont[1].values())  # cancels out for a symbol never seen
        near = [c for h, c in cont[k].items() if h >> bits == g >> bits]
        if not near:
            return shared(g, k - 1)
        return (max(cont[k][g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(near) * shared(g, k - 1)) / sum(near)

    def p(g, of):
        near = [c for h, c in of.items() if h >> bits == g >> bits and c]
        back = toxicity.DISCOUNT * len(near) + toxicity.BACKOFF
        return (max(of[g] - toxicity.DISCOUNT, 0) + back * shared(g, toxicity.ORDER - 1)) / (sum(near) + toxicity.BACKOFF)

    # Groups seen, those of a word of one document alone, unseen ones after seen contexts, and after new ones.
    new = ["rarest", "abz", "aaaaaaz", "zabcab", *texts[0].split()]
    table = {r["gram"]: (r["m0"], r["m1"], r["m2"]) for r in toxicity.log_ratios(counts).collect()}
    for m, (ordinary, toxic) in n.items():
        cont = continuations(ordinary | toxic)
        some = sorted(ordinary | toxic)[::40]
        assert all(abs(sum(p(g & ~low(1) | x, c) for x in symbols) - 1) < 1e-4 for g in some for c in (ordinary, toxic) if any(h >> bits == g >> bits for h in ordinary | toxic))
        ratios = toxicity.Ratios(np.array(list(table), np.int64), np.array([v[m] for v in table.values()]))
        for w in new:
            want = sum(math.log(p(g, toxic) / p(g, ordinary)) for g in grams_of(w))
            ratio, letters = ratios.of_words(toxicity.words_of(w.encode()))
            assert abs(ratio[0] - want) < 1e-4 and letters[0] == len(w.encode())
    abz = grams_of("abz")[2]
    assert abz not in table and table[abz | toxicity.OTHER][2] != 0


def test_toxicity_joined_equals_broadcast(spark):
    docs, labels = queries.read(spark, "/root/testdata/sf0.01", "documents").limit(150), queries.read(spark, "/root/testdata/sf0.01", "labels")
    docs = docs.unionByName(docs_of(spark, AWKWARD).select(docs.columns))
    model = toxicity.train(docs, labels)
    fields = [toxicity.T.StructField(c, toxicity.T.DoubleType()) for c in "abc"]
    a, b = ([tuple(r) for r in toxicity.judged(docs, model.ratios, model.rows, fields, lambda x: list(x.T), most=most).select("doc_id", "text", *"abc").collect()] for most in (10**9, 0))
    assert Counter(a) == Counter(b) and any(r[2] for r in a)
    training = [Counter(map(tuple, labelled.training_documents(docs, labels, "toxic", 4, 2, most=most).collect())) for most in (10**9, 0)]
    assert training[0] == training[1] and training[0]


# --- 9 sharding ---


def test_shards(spark):
    rng = random.Random(11)
    texts = AWKWARD[:8] + ["hot group " * 20] * 700 + ["w" * rng.randrange(400) + str(i) for i in range(1500)]
    rows = sharding.shard_by_bytes(docs_of(spark, texts), 16).collect()
    assert len(rows) == len(texts)
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 16
    assert max(size.values()) <= 1.05 * mean and min(size.values()) >= 0.95 * mean
    # Shards are in key order: equal texts are neighbours, unless a boundary cuts their group.
    runs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        if not runs[r["text_crc32"]] or runs[r["text_crc32"]][-1] != (r["shard"], r["slot"] - 1):
            runs[r["text_crc32"]].append((r["shard"], r["slot"]))
        else:
            runs[r["text_crc32"]][-1] = (r["shard"], r["slot"])
    assert all(len({s for s, _ in v}) == len(v) for v in runs.values())
    assert sharding.shard_by_bytes(docs_of(spark, texts).limit(0)).collect() == []
    assert len(sharding.shard_by_bytes(docs_of(spark, ["one"])).collect()) == 1


def test_shards_cut_repeated_rows(spark):
    rows = [(7, "the same row")] * 400 + [(None, None)] * 100 + [(i, f"text number {i} of many") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = Counter()
    for r in sharding.shard_by_bytes(df).collect():
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(size.values()) <= mean + 40 and min(size.values()) >= mean - 40


def test_splitters_equal_a_sort(spark):
    rng = random.Random(14)
    keys = [(rng.getrandbits(64) - (1 << 63) if rng.random() < 0.6 else 5 << 40 | rng.getrandbits(20), rng.randrange(1, 50)) for _ in range(3000)]
    cuts = sharding.splitters(spark.createDataFrame(keys, "key long, size long"), 8, 0.001)
    total = sum(s for _, s in keys)
    for j, cut in enumerate(cuts, 1):
        below = sum(s for k, s in keys if k % (1 << 64) < cut)
        assert abs(below - total * j / 8) <= 50 + 0.01 * total / 8


def test_write_shards(spark, tmp_path):
    df = docs_of(spark, AWKWARD + ["copy"] * 20)
    sharding.write_shards(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.drop("shard").select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert {r["shard"] for r in back.select("shard").collect()} <= {0, 1, 2, 3}
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("SHARD", F.lit(1)), f"{tmp_path}/other", 4)


# --- 10 URLs ---


def test_urls_equal_brute_force(spark):
    rules = [*queries.URL_RULES, ("a.b.c", None, "block"), ("b.c", "/x", "allow"), ("c", "/x/y", "block"), ("", "/", "block"), (None, "/", "block")]
    rng = random.Random(12)
    hosts = ["example.com", "WWW.Example.com", "xexample.com", "com", "net", "a.net", "a.b.c", "z.a.b.c", "b.c", "c", "", "a..com", "example.com:80"]
    urls_ = [None, "", "no scheme", "://", "http://", "ftp://x\n.com/en/"] + ["http://" + rng.choice(hosts) + rng.choice(["", "/", "/en/", "/en/1?x=://", "/es/a#b", "?q", "#f", "/x", "/x/y/z", "/fr"]) for _ in range(800)]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls_)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(df, urls.rules_table(spark, rules), partitions=5).collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fits = [(h + (p or ""), v, h) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        rule, verdict, _ = max(fits, key=lambda f: (len(f[0]), len(f[2])), default=(None, "allow", None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u
    assert urls.judge_urls(df.limit(0), urls.rules_table(spark, rules)).collect() == []
