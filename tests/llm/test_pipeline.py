"""The corpus pipeline: the order of the mix in the token files."""

import corpus_pipeline
from helpers import SCHEMA, prose
from pyspark.sql import functions as F

from tidewatch.llm import mixing


def folder(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(9_000, 40))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_starts_follow_the_mix(spark, tmp_path):
    rows = [(i, prose(i, 30 + i % 7), "en", "a" if i % 5 else "b") for i in range(400)]
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    placed = mixing.interleave(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "source")).select("doc_id", "position").collect()
    want = [r["doc_id"] for r in sorted(placed, key=lambda r: r["position"])]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == want != sorted(want)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]


def test_left_out_mixing_shows(spark, tmp_path, monkeypatch):
    path = folder(spark, tmp_path, [(i, prose(i, 30), "en", "a" if i % 5 else "b") for i in range(200)])
    whole = {tuple(r) for r in corpus_pipeline.run(spark, path).collect()}
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, f) for n, f in corpus_pipeline.STAGES if n != "mixing"])
    assert {tuple(r) for r in corpus_pipeline.run(spark, path).collect()} != whole


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0
