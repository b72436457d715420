"""Whole passages within texts, whatever they share with other passages."""

import duckdb
import pandas as pd

from attestor.operators import passages
from attestor.plans import text_queries


def test_passages_of_one_head_short_ones_and_blocks(spark, monkeypatch):
    """Heads of 40 characters in common, one passage within another, the same one twice, one character, letters beyond 16 bits, blocks of one."""
    head = "x\U0001f600" * 20
    asked = [(1, head + "a"), (2, head + "ab"), (3, head), (4, "b"), (5, "b"), (6, ""), (7, None), (8, head[1:] + "abc"), (9, "é"), (10, "none of these")]
    read = [(1, head + "ab"), (2, head + "b" + head + "a"), (3, ""), (4, None), (5, "é"), (5, "éb"), (6, head[:-1])]
    expected = sorted((d, n) for d, body in read for n, p in asked if p and body and p in body)
    for size in (10**6, 1):
        monkeypatch.setattr(passages, "BLOCK_CHARS", size)
        got = passages.found(spark.createDataFrame(read, "d long, body string"), "body", "d", spark.createDataFrame(asked, "i long, p string"), "p", "i")
        assert sorted(map(tuple, got.collect())) == expected
    none = spark.createDataFrame([], "i long, p string")
    assert passages.found(spark.createDataFrame(read, "d long, body string"), "body", "d", none, "p", "i").count() == 0


def test_value_location_of_repeated_rows(spark, tmp_path):
    """Documents and passages that stand twice count twice, as in the SQL; texts are read once, without a shuffle of them."""
    docs = pd.DataFrame({"doc_id": [3, 3, 5, 8], "text": ["a b, c", "ab c d", None, "c d"]})
    bench = pd.DataFrame({"item_id": [1, 1, 2, 4], "text": ["a bc", "b c", "c,d", " "]})
    docs.to_parquet(tmp_path / "documents.parquet")
    bench.to_parquet(tmp_path / "benchmark.parquet")
    out = text_queries.value_location(spark, str(tmp_path))
    with duckdb.connect() as c:
        c.register("documents", docs)
        c.register("benchmark", bench)
        expected = c.execute(text_queries.ORACLE["value_location"]).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
