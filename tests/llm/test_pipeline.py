import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.limit(3).select((F.col("doc_id") + 100000).alias("doc_id"), "text", "lang", "source", "n_chars").union(
        spark.createDataFrame([(200000, None, "en", "s", 0), (200001, "12 !", None, None, None), (200002, "token=abcdef012345 fine words of text here", "en", "s", 5)], docs.schema)
    )
    docs = docs.union(extra)
    start = {r["doc_id"] for r in docs.collect()}
    seen = [start]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows)
        seen.append({r["doc_id"] for r in rows})
        if name == "language_id":
            assert seen[0] - seen[1] == {200000, 200001}
        if name == "near_dedup":
            copies = {r["doc_id"] for r in extra.collect() if r["doc_id"] < 200000}
            assert not copies & seen[2] and copies <= seen[1]
        if name == "secret_scan":
            assert seen[3] == seen[4]
            assert next(r for r in rows if r["doc_id"] == 200002)["text"] == "[secret] fine words of text here"
    assert seen[4] == seen[5]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_run(spark):
    out = pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_clashing_columns(spark):
    """Extra columns whose names the stages use inside come through all of them unchanged."""
    names = ["score", "lang_pred", "base", "found", "more", "component_id", "item_id", "sh", "n_words", "row", "s", "h", "__x"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in rows), name
    assert pipeline.STAGES[-1][1](spark, docs, DATA).count() == 40
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
