"""What surrounds a study: replies, partial scores, configurations, flags, composed answers, frozen edges, loaders."""

import pytest
from pyspark.sql import functions as F

from attestor.operators import studies


def test_units(spark):
    rows = [("g", "grid", [["a ", "1 g"], ["b"]]), ("s", "spec_table", [["Item", "Specification"], ["Mass", " 5 g\n\n or 6 "], ["only 7"], []]), ("o", "other", [["1"]])]
    got = {r["unit_id"]: (r["kind"], r["render"]) for r in studies.extraction_units(spark.createDataFrame(rows, "region_id string, kind string, rows array<array<string>>")).collect()}
    assert got == {
        "g_grid": ("grid", "| a | 1 g |\n| b |  |"), "s_r1": ("spec_row", "Item: Mass\nSpecification:\n  5 g\n  or 6"), "s_r2": ("spec_row", "Item: only 7\nSpecification:\n"),
    }


def test_grid_replies(spark):
    one = '{"family": "rel_capacity", "axis_kind": "temperature_c", "axis_value": "-20", "value": 5, "unit": "%"}'
    replies = [f"```json\n[{one}]\n```", "no", f"[{one.replace('5,', '[1, 2, 3],')}, {{\"family\": \"rel_capacity\"}}]", f"[{one.replace('rel_capacity', 'mass')}]", f"[{one.replace('-20', 'cold')}]", f"[{one.replace('5,', chr(34) + 'x' + chr(34) + ',')}]"]
    rows = studies.grid_replies(spark.createDataFrame(list(enumerate(replies)), "n long, reply string"), "reply").collect()
    got = [(r["n"], r["error"], r["property"] is not None) for r in sorted(rows, key=lambda r: (r["n"], r["error"] or ""))]
    assert got == [(0, None, True), (1, "no_list", False), (2, None, True), (2, "missing: axis_kind, axis_value, value", False), (3, "unknown_family", False), (4, "unknown_axis", False), (5, "malformed_value", False)]


def test_partial_scores(spark):
    matched = spark.createDataFrame([("a", "tp", True), ("a", "fp", False), ("b", "fp", None), ("b", "fn", None)], "d string, outcome string, in_source boolean")
    got = {r["d"]: (r["tp"], r["fp"], r["fn"], r["hallucinations"], r["source_checks"]) for r in studies.partial_scores(matched, spark.createDataFrame([("a", "text"), ("b", None)], "d string, text string"), "d").collect()}
    assert got == {"a": (1, 1, 0, 1, "available"), "b": (0, 1, 1, None, "unavailable")}


def test_configurations(spark):
    gold = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k long")
    said = spark.createDataFrame([("raw", 1), ("raw", 2), ("raw", 9), ("raw", 9), ("v", 1)], "config string, k long")
    got = {r["config"]: r for r in studies.compared_configurations(gold, said, ["k"], [("v", "raw")]).collect()}
    assert (got["raw"]["tp"], got["raw"]["fp"], got["raw"]["fn"], got["raw"]["false_rejections"]) == (2, 1, 1, None)
    assert (got["v"]["precision"], got["v"]["false_rejections"], got["v"]["false_rejection_rate"]) == (1.0, 1, 0.5)


def test_pairs_of_documents(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "d string") for t in ("xxy", "xz"))
    assert [tuple(r) for r in studies.paired_documents(a, b, "d", strict=False).collect()] == [("x", 2, 1)]
    with pytest.raises(FileNotFoundError, match="y, z"):
        studies.paired_documents(a, b, "d")


def test_promises_refuse_stale_gaps(spark):
    models, claimed = spark.createDataFrame([("a",), ("b",)], "m string"), spark.createDataFrame([("a", 1.0), ("a", 3.0)], "m string, claim double")
    measured = spark.createDataFrame([("a", 2.0), ("a", 4.0)], "m string, value double")
    gap = lambda n: spark.createDataFrame([("a", n, 0.5)], "m string, n long, gap double")
    got = {r["m"]: (r["n_claims"], r["n"], r["median"], r["gap"]) for r in studies.promises(models, claimed, measured, gap(2), "m").collect()}
    assert got == {"a": (2, 2, 3.0, 0.5), "b": (0, 0, None, None)}
    with pytest.raises(Exception, match="other measurements"):
        studies.promises(models, claimed, measured, gap(3), "m").collect()


def test_omissions(spark):
    omitted = spark.createDataFrame([("a", "mass"), ("b", "mass"), ("c", "mass"), ("a", "odd")], "doc string, property string")
    pages = spark.createDataFrame([("a", "nothing"), ("a", "at all"), ("b", "x"), ("b", "its MASS"), ("c", None)], "doc string, text string")
    words = spark.createDataFrame([("mass", "(?i)mass")], "property string, pattern string")
    assert {(r["doc"], r["property"]): r["verified"] for r in studies.checked_omissions(omitted, pages, words).collect()} == {("a", "mass"): True, ("b", "mass"): False, ("c", "mass"): False, ("a", "odd"): False}


def test_edges(spark, tmp_path):
    edges = spark.createDataFrame([("v", 1, 2, 0.5, True), ("v", 1, 3, 0.7, False), ("w", 1, 2, 0.1, True)], "view string, src long, dst long, weight double, same_group boolean")
    names = spark.createDataFrame([(2, "two")], "id long, name string")
    assert [tuple(r) for r in studies.neighbourhood(edges, "v", 1, 5, names).orderBy("rank").collect()] == [(1, 3, 0.7, None), (2, 2, 0.5, "two")]
    for view, center, k, error in (("x", 1, 5, KeyError), ("v", 9, 5, KeyError), ("v", 1, 0, ValueError)):
        with pytest.raises(error):
            studies.neighbourhood(edges, view, center, k, names)
    at = f"file://{tmp_path}/frozen"
    first = sorted(map(tuple, studies.frozen_edges(edges, at).collect()))
    assert sorted(map(tuple, studies.frozen_edges(edges.where("false"), at).collect())) == first and studies.frozen_edges(edges, at).columns == list(studies.EDGES)


def test_loaders_go_on(spark, tmp_path):
    loaders = {"a": lambda: spark.range(3), "b": lambda: None, "c": lambda: spark.range(1).select(F.raise_error(F.lit("x"))), "d": lambda: 1 / 0, "e": lambda: spark.range(2)}
    got = {r["study"]: (r["state"], r["detail"]) for r in studies.loaded(spark, loaders, f"file://{tmp_path}/s").collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "loaded", "b": "skipped", "c": "failed", "d": "failed", "e": "loaded"} and got["a"][1] == "3" and got["d"][1] == "ZeroDivisionError"
