"""Held-out accuracy of the classifiers on the small tables, and the pipeline's stages."""

import pyarrow.parquet as pq

from attestor.llm import boosting, queries

FOLDER = "/root/testdata/sf0.1"


def held_out(spark, query, label, folder=FOLDER):
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    truth = dict(zip(labels["doc_id"], labels[label], strict=True))
    rows = [r for r in query(spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 100
    return sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)


def test_toxicity(spark):
    assert held_out(spark, queries.op3_toxicity, "toxic") > 0.97


def test_quality(spark):
    assert held_out(spark, queries.op8_quality, "quality") > 0.97


def test_isotonic_is_monotone():
    import numpy as np

    rng = np.random.default_rng(0)
    score = rng.random(500)
    x, y = boosting.isotonic(score, (rng.random(500) < score).astype(float))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and abs(np.interp(0.5, x, y) - 0.5) < 0.15


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    assert 0 < out.count() < docs.count() and "doc_id" in out.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
