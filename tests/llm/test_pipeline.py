"""Decontamination against the full table of edit distances, trees against a plain walk, and the odd rows of the pipeline's stages."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from attestor.llm import boosting, decontaminate, queries

FOLDER = "/root/testdata/sf0.001"


def normal(text):
    return " ".join((text or "").lower().split())


def plain_matches(texts, items, rate=0.08, least=24):
    """{(doc, item): distance} of items within the budget, by the full table of edit distances over all texts at once."""
    gap, found = 600, {}
    ids, spans, chars = list(texts), [], []
    at = 0
    for d in ids:
        t = normal(texts[d])
        spans.append((at, at + len(t)))
        chars.append(t + "\0" * gap)
        at += len(t) + gap
    text = np.frombuffer("".join(chars).encode("utf-32-le"), np.uint32)
    steps = np.arange(len(text) + 1)
    for i, item in items.items():
        pattern = normal(item)
        k = int(len(pattern) * rate) if len(pattern) >= least else 0
        assert k < gap - len(pattern)
        row = np.zeros(len(text) + 1, np.int64)
        for n, c in enumerate(pattern):
            new = np.empty_like(row)
            new[0] = n + 1
            new[1:] = np.minimum(row[:-1] + (text != ord(c)), row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
        for d, (a, b) in zip(ids, spans, strict=True):
            best = int(row[a : b + 1].min())
            if pattern and best <= k:
                found[d, i] = best
    return found


@pytest.fixture(scope="module")
def tables():
    docs, items = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict(), pq.read_table(f"{FOLDER}/benchmark.parquet").to_pydict()
    return dict(zip(docs["doc_id"], docs["text"], strict=True)), dict(zip(items["item_id"], items["text"], strict=True))


def test_op7_equals_edit_distances(spark, tables):
    texts, items = tables
    short = {d: t for d, t in texts.items() if len(t or "") < 6_000}
    expected = plain_matches(short, items)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op7_decontaminate(spark, FOLDER).collect()}
    assert {k: v for k, v in got.items() if k[0] in short} == expected and len(expected) == 3


def test_short_items_are_found_as_whole_words(spark):
    items = spark.createDataFrame([(1, "blue whale"), (2, "日本語の質問"), (3, ""), (4, None)], "item_id long, text string")
    texts = ["A Blue  Whale.", "blue whales", "the bluewhale", "blu whale", "だ日本語の質問", "(日本語の質問)", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, items).collect()) == [(0, 1, 0), (4, 2, 0), (5, 2, 0)]
    assert {r["doc_id"] for r in decontaminate.without_matches(docs, items).collect()} == {1, 2, 3, 6}


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    forest = boosting.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=12, depth=3)
    for row, p in zip(x, forest.probability(x), strict=True):
        margin = forest.bias
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        assert abs(p - 1 / (1 + np.exp(-margin))) < 1e-12


def test_stages_take_odd_rows_and_empty_tables(spark):
    import corpus_pipeline

    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    long = "nothing to see in this sentence of ordinary words. " * 2_000
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "no id here at all", "en", "a", 17), (3, long, "en", "b", len(long)), (3, long, "en", "b", len(long))]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).collect()
        assert {r["doc_id"] for r in out} == {1, 2, 3, None}, name
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
