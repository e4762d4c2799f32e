"""The pipeline's stages on a small folder of tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import quality, toxicity
from marlstone.llm.common import read

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    labels = {r["doc_id"]: r for r in read(spark, SF, "labels").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF).cache()
        out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append(out)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[2]) < len(ids[1]) < len(ids[0])
    clean = {i for i, r in labels.items() if r["quality"] == 1}
    assert len(clean & ids[1]) >= 0.97 * len(clean)
    toxic = {i for i, r in labels.items() if r["toxic"] == 1} & ids[1]
    assert len(toxic - ids[2]) >= 0.7 * len(toxic)
    assert seen[3].count() == len(ids[3])
    assert seen[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_scores_do_not_need_other_columns(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text")
    labels = read(spark, SF, "labels")
    a = {r["doc_id"]: r["score"] for r in toxicity.predictions(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.predictions(read(spark, SF, "documents").repartition(5), labels).collect()}
    assert a == b
    assert quality.predictions(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]


def test_stages_with_awkward_rows(spark, tmp_path):
    docs = read(spark, SF, "documents").limit(200)
    odd = [(None, None, "en", None, None), (None, "", "en", "a", 0), (None, "no id at all here", None, "a", 5), (9001, None, None, None, None), (9002, " \n", "en", "a", 2)]
    odd += [(9003, "long " * 200_000 + "end", "en", "b", 1_000_003), (9004, "x" * 300_000, "en", "b", 300_000)] + [(9005, "this row is here three times", "en", "a", 28)] * 3 + [(9005, "but this one has other words", "en", "a", 28)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for i, c in enumerate(("quality", "Toxicity", "score", "spans", "d", "row", "chunk", "group", "__quality", "odd name", "a.b")):
        docs = docs.withColumn(c, F.lit(i))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            rows = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                assert all(r["odd name"] == 9 and r["a.b"] == 10 for r in rows)
            assert rows or given is not docs
    texts = [r["text"] for r in simhash_rows(spark, docs)]
    assert texts.count("this row is here three times") == 1 and texts.count("but this one has other words") == 1 and "no id at all here" in texts
    assert len(corpus_pipeline.mixing_stage(spark, docs.where("doc_id = 9003"), str(tmp_path)).collect()) in (1, 2)


def simhash_rows(spark, docs):
    return corpus_pipeline.simhash_stage(spark, docs, "").collect()


def test_texts_reach_python_in_small_batches(spark):
    """Before, a task held 10,000 texts outside the heap and as many in its worker."""
    from pyspark.sql import types as T

    from marlstone.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        docs = spark.range(0, 3500, 1, 1).selectExpr("id as doc_id", "string(id) as text")
        out = common.append_columns(docs, "text", [T.StructField("together", T.LongType())], lambda: lambda texts: [[len(texts)] * len(texts)])
        assert out.agg({"together": "max"}).first()[0] == common.BATCH_ROWS
        assert out.where("together is not null").count() == 3500
        spark.conf.set(name, 7)
        common.bounded_batches(spark)
        assert int(spark.conf.get(name)) == 7
    finally:
        spark.conf.set(name, before)


def test_training_gives_the_drivers_memory_back(spark, monkeypatch):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    for module in (quality, toxicity):
        given = []
        monkeypatch.setattr(module, "release", lambda given=given: given.append(1))
        module.train(docs, labels)
        assert given, module.__name__
