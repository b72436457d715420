"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.sources import cycles, feeds, reports
from attestor.streaming import candidates


def test_search_results(spark):
    page = {"total": 3, "data": [
        {"paperId": "1", "title": "New", "year": 2025, "venue": "V", "externalIds": {"DOI": "10.1/A"}, "abstract": "x" * 2000, "authors": [{"name": str(i)} for i in range(20)]},
        {"paperId": "2", "title": "Old", "year": 2019}, {"paperId": "3", "title": "Pre", "year": 2024, "externalIds": {"ArXiv": "2401.1"}}, {"title": "", "year": 2025},
    ]}
    got = {r["candidate_id"]: r for r in feeds.search_results(spark.createDataFrame([(json.dumps(page),), ("broken",)], "p string"), "p").collect()}
    assert set(got) == {"doi:10.1/a", "arxiv:2401.1"}
    assert len(got["doi:10.1/a"]["authors"]) == 12 and len(got["doi:10.1/a"]["abstract"]) == 1500


def test_atom_entries(spark, tmp_path):
    entry = "<entry><id>http://x/abs/2405.1v1</id><title> A\nB </title><published>{}-05-01</published><summary> s </summary><author><name>N</name></author></entry>"
    (tmp_path / "feed.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom">' + entry.format(2024) + entry.format(2020) + "</feed>")
    got = feeds.atom_entries(spark, str(tmp_path / "feed.xml")).collect()
    assert [(r["candidate_id"], r["title"], r["year"], r["authors"]) for r in got] == [("arxiv:2405.1v1", "A B", 2024, ["N"])]


def test_claim_documents(spark):
    doc = {"cell_model": "M", "claims": [{"property": "p", "value": 1.5, "unit": "A", "page": 2, "stated_conditions": {"text": "at 5 A", "current": "5"}}, {"property": "p", "value": [1, 2]}], "omissions": [{"property": "q", "note": "n"}]}
    df = spark.createDataFrame([("d", json.dumps(doc))], "name string, body string")
    got = sorted(feeds.claim_documents(df, "name", "body").collect(), key=lambda r: r["pos"])
    assert [(r["claim_id"], r["value"], r["conditions_text"]) for r in got] == [("d:p:0", "1.5", "at 5 A"), ("d:p:1", "[1,2]", None)]
    assert got[0]["conditions"] == {"current": "5"}
    assert feeds.omissions(df, "name", "body").first() == ("d", "q", "n")


def test_replies_and_pages(spark):
    df = spark.createDataFrame([(1, 'Here: [{"property": "p", "value": "3"}] done'), (2, "sorry")], "n long, reply string")
    got = {r["n"]: r for r in feeds.reply_claims(df, "reply").collect()}
    assert got[1]["property"] == "p" and got[1]["stated_conditions"] == {"text": "unspecified"} and got[2]["parse_error"]
    pages = feeds.pages_of(spark.createDataFrame([("d", "x=== PAGE 1 ===a=== PAGE 3 ===b")], "k string, t string"), "k", "t").collect()
    assert [(r["page"], r["text"]) for r in pages] == [(1, "a"), (3, "b")]


def test_files(spark, tmp_path):
    good = tmp_path / "SNL_NMC_25C_0-100_0.5-1C_a_cycle_data.csv"
    good.write_text("cycle,cap\n1,2.0\n2,bad\n")
    (tmp_path / "other.csv").write_text("cycle,cap\n1,2.0\n")
    rows = cycles.named_csv(spark, str(tmp_path), "cycle long, cap double").collect()
    assert [(r["cycle"], r["cap"], r["chemistry"], r["temperature_c"], r["cell"]) for r in rows] == [(1, 2.0, "NMC", 25.0, "a"), (2, None, "NMC", 25.0, "a")]
    want = spark.createDataFrame([(good.name, good.stat().st_size), ("other.csv", 5), ("none.csv", 5)], "name string, size long")
    assert {r["name"]: r["state"] for r in cycles.landing(spark, str(tmp_path), want).collect()} == {good.name: "ready", "other.csv": "oversized", "none.csv": "missing"}


def test_steps(spark):
    rows = [("c", 1, i, "CC charge", 110.0 * i, 60.0 * i) for i in range(10)] + [("c", 1, 10 + i, "CC discharge", 1100.0 - 18.0 * i, 600.0 + i) for i in range(60)] + [("c", 2, 99, "discharge", 1.0, 1.0)]
    got = {r["cycle"]: r for r in cycles.step_summary(spark.createDataFrame(rows, "cell string, cycle long, n long, status string, cap double, t double"), "cell", "cycle", "n", "status", "cap", "t").collect()}
    assert got[1]["discharged_ah"] == pytest.approx(18.0 * 59 / 1000) and got[1]["charge_min"] == 9.0 and got[2]["discharged_ah"] is None


def test_codes_and_truncation(spark):
    r = spark.createDataFrame([([72, 105, 0], [1.0, 2.0], [1.0])], "c array<int>, a array<double>, b array<double>")
    assert r.select(cycles.decoded("c")).first()[0] == "Hi"
    assert list(r.select(*cycles.truncated("a", "b")).first()) == [[1.0], [1.0]]


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 1.5), ("50%", None)], "name string, x double")
    assert "a\\|b" in reports.markdown(df) and r"50\%" in reports.latex(df)
    with pytest.raises(ValueError):
        reports.markdown(df, most=1)


def test_stream_stages_once_and_promotes(spark, tmp_path):
    schema = T.StructType.fromDDL("candidate_id string, title string")
    shelf = candidates.CandidateStore(spark, f"{tmp_path}/store", schema)
    source = f"{tmp_path}/in"
    one = spark.createDataFrame([("a", "A"), ("a", "B"), ("b", "C")], schema)
    one.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    candidates.stage_stream(stream(), shelf, f"{tmp_path}/cp").awaitTermination(120)
    assert sorted((r["candidate_id"], r["title"], r["status"]) for r in shelf.staged().collect()) == [("a", "A", "pending_review"), ("b", "C", "pending_review")]
    one.unionByName(spark.createDataFrame([("c", "D")], schema)).coalesce(1).write.mode("append").parquet(source)
    candidates.stage_stream(stream(), shelf, f"{tmp_path}/cp").awaitTermination(120)
    assert shelf.staged().count() == 3
    with pytest.raises(PermissionError):
        shelf.promote("a", confirm=False)
    assert shelf.promote("a", confirm=True) == "lit_a" and shelf.pending().count() == 2
    with pytest.raises(KeyError):
        shelf.promote("zzz", confirm=True)


def test_windows_over_a_stream(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 20) as ts, id % 2 as k from range(12)").coalesce(1).write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("ts timestamp_ntz, k long").parquet(f"{tmp_path}/e")
    q = candidates.windowed_counts(events, "ts", "0 minutes", "1 hour", ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 1, 1, 1, 2, 2, 2, 2]
    s = candidates.sessions(events, "ts", "0 minutes", "30 minutes", ["k"]).writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert len(spark.table("s").collect()) == 12
    assert spark.table("w").select(F.sum("n")).first()[0] == 12
