from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame, _ = corpus_pipeline.stash(stage(spark, frame, sf))
        assert frame.columns == docs.columns, name
        ids = {r.doc_id for r in frame.collect()}
        assert ids and ids <= seen[-1]
        seen.append(ids)
    assert frame.count() >= len(seen[-1])
    out = corpus_pipeline.encode(spark, frame, sf)
    assert out.count() == frame.count() and out.filter(~F.col("exact")).isEmpty()


def test_odd_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        frame = docs
        for _, stage in corpus_pipeline.STAGES:
            frame, _ = corpus_pipeline.stash(stage(spark, frame, ""))
        assert frame.count() <= 3 * docs.count()


def test_columns_with_internal_names(spark):
    text = "one text of fifty words or more is kept by the rules " * 1 + " ".join(f"word{k} and then" for k in range(60))
    rows = [(i, text if i < 3 else text.replace("word7", f"other{i}"), f"s{i % 2}", *[f"keep{i}"] * 9) for i in range(6)]
    names = ["__key", "__n", "__passes", "__threshold", "__id", "__digest", "__own", "__text", "__WORDS"]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame, _ = corpus_pipeline.stash(stage(spark, frame, ""))
        assert frame.columns == docs.columns, name
        assert all(r[n] == f"keep{r.doc_id}" for r in frame.collect() for n in names), name
    assert frame.count() == 1
