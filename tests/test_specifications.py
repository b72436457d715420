"""Specification lines, review pages, kinds of claims and the consistency of documents."""

import pytest
from pyspark.sql import functions as F

from attestor.functions import claim_kinds, reviews, specifications, text
from attestor.operators import claims, consistency

PAGE = """<html><p>At 20A the cell reaches 81°C. At 30A I terminated due to temperature, but the cell do reach 90°C after termination.</p>
<p>It was able to deliver 30A, but only for two minutes. And 5A more: deliver 7A, but only for several minutes</p>
In my test I only discharges to 2.8 volt.<br>Official specifications: <ul><li>Nominal Capacity: 9999mAh<li>Weight: <b>45</b> g</li>
<li> </li><li>third</ul><ul><li>other</ul><img src="pics/My%20Cell-Capacity.png"><img src="pics/b-Capacity.png"><IMG src="x-Energy.png">"""


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Recommended fast charge current: 5A to 3.6v CCCV, 15min", [("fast_charge_current_a", [5.0], {})]),
        (
            "Cycle life: 300 at 10A, 200 at 20A both with 4A charge, ramaning capacity minimum 70%",
            [("cycle_life_cycles", [n], {"discharge_current_a": a, "charge_current_a": 4.0, "retention_pct": 70.0}) for n, a in ((300.0, 10.0), (200.0, 20.0))],
        ),
        ("Cycle life at 10C discharge, 100% DOD: Over 1,000 cycles", [("cycle_life_cycles", [1000.0], {"discharge_c_rate": 10.0, "dod_pct": 100.0})]),
        ("Cut off at 2.75V, full charge 4.35V (Wrong value)", [("discharge_cutoff_v", [2.75], {}), ("charge_voltage_v", [4.35], {})]),
        ("Cut off at 2.75V", [("discharge_cutoff_v", [2.75], {})]),
        ("Standard charge: 1500mA, 4.2V, 50mA", [("std_charge_current_a", [1.5], {"charge_voltage_v": 4.2})]),
        ("Nominal Capacity & Voltage: 1.1Ah, 3.3v", [("nominal_capacity_ah", [1.1], {}), ("nominal_voltage_v", [3.3], {})]),
        ("Real capacity: 2,600mAh", [("nominal_capacity_ah", [2.6], {})]),
        ("Fast discharge: 10,000mA, 20A", [("fast_discharge_current_a", [10.0, 20.0], {})]),
        ("Max charge voltage: 4.2 V", [("max_charge_voltage_v", [4.2], {})]),
        ("Standard discharge: 500 mA to 2.5 V", [("std_discharge_current_a", [0.5], {"discharge_cutoff_v": 2.5})]),
        ("Operating temperature: charge 0~45°C, discharge: -20~60°C", [("charge_temp_range_c", [0.0, 45.0], {}), ("discharge_temp_range_c", [-20.0, 60.0], {})]),
        ("Operating temp: -30°C ~ +60°C", [("operating_temp_range_c", [-30.0, 60.0], {})]),
        ("Storage temperature: 1 month: 0~60, 1 year: -20~25", [("storage_temp_range_c", [-20.0, 25.0], {})]),
        ("charge/cut-off voltage: 3.5v to 2v", [("charge_voltage_v", [3.5], {}), ("discharge_cutoff_v", [2.0], {})]),
        ("Netweight: Max 47.5g", [("mass_g", [47.5], {})]), ("nothing of the kind", []), ("", []), (None, []),
        ("Real capacity: 1.2.3mAh", [("nominal_capacity_ah", [None], {})]),
    ],
)
def test_lines(spark, line, expected):
    rows = spark.createDataFrame([(line,)], "line string").select(F.inline(specifications.entries(F.col("line")))).collect()
    assert [(r["property"], r["value"] if r["value"][0] is None else [pytest.approx(v) for v in r["value"]], r["conditions"]) for r in rows] == expected


def test_review(spark):
    r = reviews.assembled(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>At 2A the cell reaches " + "9" * 300 + " C")], "id int, html string"), "html", "id").orderBy("id").collect()
    assert r[0]["spec_echo"] == ["Nominal Capacity: 9999mAh", "Weight: 45 g", "third"] and (r[0]["n_stated"], r[0]["n_charts"]) == (5, 1)
    found = [(m["property"], m["value"], m["conditions"], m["chart_only"]) for m in r[0]["measurements"]]
    assert found == [
        ("measured_cell_temp_c", 81.0, {"discharge_current_a": 20.0}, False), ("measured_cell_temp_c", 90.0, {"discharge_current_a": 30.0}, False), ("measured_sustained_current_a", 30.0, {"duration_min": 2.0}, False),
        ("measured_sustained_current_a", 7.0, {}, False), ("test_discharge_cutoff_v", 2.8, {}, False), ("measured_capacity_ah", None, {}, True),
    ]
    assert r[0]["measurements"][5]["fragment"].endswith(": My Cell-Capacity.png")
    assert r[1]["measurements"] == [] == r[1]["spec_echo"] and len(r[2]["measurements"][0]["fragment"]) == 240


def test_kinds(spark):
    kind = lambda p, u="A", n="", c="": spark.range(1).select(claim_kinds.category(*map(F.lit, (p, u, n, c)))).first()[0]
    assert kind("height", "MM") == kind("height_mm") == "cell dimensions" and kind("x_end_current") == "charge-termination (cut-off) currents"
    assert kind("discharge_cutoff_v") == kind("max_x") == "limit specs (max current / cut-off voltage)"
    assert kind("storage_x", c="three months") == "storage-duration rows" and kind("storage_x", c="monthly") == "other"
    assert kind("y", n="Read off the page") == "plot-derived values" and kind("y", c="a test of it") == "test-criterion rows" and kind("y", c="latest") == "other"
    where = lambda p, n=None, c=None: spark.range(1).select(claim_kinds.stratum(F.lit(p), F.lit(n).cast("string"), F.lit(c).cast("string"))).first()[0]
    assert (where("rel_x", "graph"), where("a", None, "a Graph"), where("a")) == claim_kinds.STRATA
    f = spark.createDataFrame([("d/SNL_18650_LFP_25C_0-100_0.5-1.0C_a_cycle_data.csv",), ("else.csv",)], "n string").select(claim_kinds.file_fields(F.col("n")).alias("f")).collect()
    assert tuple(f[0]["f"]) == (25.0, "0-100%", "0.5C", "1C", "a") and f[1]["f"] is None


def test_consistency(spark):
    """Pairs by the closest value, bounds, conditions, gaps that are verified or not, documents of one manufacturer."""
    gold = spark.createDataFrame(
        [
            ("m", "datasheet_a", "cycle_life_cycles", 0, [300.0], "cycles", {"discharge_c_rate": 1.0}, None, "300 cycles", None), ("m", "datasheet_a", "cycle_life_cycles", 1, [200.0], None, None, "until 80 % is left", "200", "n"),
            ("m", "datasheet_a", "mass_g", 2, [48.0], "g", None, None, "Max. 48 g", None), ("m", "datasheet_b", "mass_g", 0, [45.0], "g", None, None, "45 g", None),
            ("m", "datasheet_a", "max_charge_current_a", 3, [2000.0], "mA", None, None, "2 A", None), ("n", "datasheet_c", "mass_g", 0, [1.0], "g", None, None, "1 g", None),
        ],
        "model string, source_id string, property string, pos long, value array<double>, unit string, conditions map<string,double>, end_condition string, text string, notes string",
    )
    echo = spark.createDataFrame(
        [("m", "review_x", "cycle_life_cycles", 0, [200.0], {"retention_pct": 70.0}, "200 at 70 %"), ("m", "review_x", "mass_g", 1, [47.0], {}, "47 g"), ("m", "review_x", "height_mm", 2, [65.0], {}, "65 mm")],
        "model string, source_id string, property string, pos long, value array<double>, conditions map<string,double>, text string",
    )
    omitted = spark.createDataFrame([("m", "datasheet_a", "height_mm")], "model string, source_id string, property string")
    entries = consistency.gold_entries(gold)
    assert {r["text"]: r["conditions"] for r in entries.collect() if r["property"] == "cycle_life_cycles"} == {"300 cycles": {"discharge_c_rate": 1.0}, "200 [n]": {"retention_pct": 80.0}}
    rows = consistency.consistency(entries, echo, omitted)
    got = {(r["source_a"], r["source_b"], r["property"], r["i"], r["j"]): r for r in rows.collect()}
    a, b, x = "datasheet_a", "datasheet_b", "review_x"
    assert {k: r["verdict"] for k, r in got.items()} == {
        (a, x, "cycle_life_cycles", 1, 0): "condition_mismatch", (a, x, "cycle_life_cycles", 0, None): "coverage_gap", (a, x, "mass_g", 2, 1): "consistent", (a, x, "max_charge_current_a", 3, None): "coverage_gap",
        (a, x, "height_mm", None, 2): "coverage_gap", (b, x, "mass_g", 0, 1): "document_variant_conflict", (b, x, "cycle_life_cycles", None, 0): "coverage_gap", (b, x, "height_mm", None, 2): "coverage_gap",
        (a, b, "mass_g", 2, 0): "consistent", (a, b, "cycle_life_cycles", 0, None): "coverage_gap", (a, b, "cycle_life_cycles", 1, None): "coverage_gap", (a, b, "max_charge_current_a", 3, None): "coverage_gap",
    }
    assert "verified" in got[a, x, "height_mm", None, 2]["detail"] and "verified" not in got[b, x, "height_mm", None, 2]["detail"]
    assert got[a, b, "mass_g", 2, 0]["provenance"] == "manufacturer_internal" and got[a, x, "mass_g", 2, 1]["provenance"] == "ecosystem"
    assert got[a, x, "cycle_life_cycles", 1, 0]["detail"] == "retention_pct: 80.0 vs 70.0" and got[a, x, "mass_g", 2, 1]["delta"] == pytest.approx(-1 / 48)
    assert consistency.summary(rows).first().asDict() == {"model": "m", "n": 12, "consistent": 2, "condition_mismatch": 1, "document_variant_conflict": 1, "coverage_gap": 8}


def test_minutes_are_no_bound(spark):
    rows = spark.createDataFrame([("4A to 3.6V CCCV, 15 min", "5A, 15min"), ("Max. 48 g", "less than 48.5 g"), ("max 5", "4")], "a string, b string")
    verdict = claims.verdict(F.array(F.lit(4.0)), F.create_map().cast("map<string,double>"), F.col("a"), F.array(F.lit(3.5)), F.create_map().cast("map<string,double>"), F.col("b"))
    assert [r[0] for r in rows.select(verdict).collect()] == ["document_variant_conflict", "document_variant_conflict", "consistent"]
    assert spark.range(1).select(text.bound(F.lit("min. 5"))).first()[0] == "lower"


def test_value_on_cited_page(spark):
    pages = spark.createDataFrame([(1, 0, "It holds 2,6 00 mAh"), (1, 1, None), (2, 0, "")], "doc long, page long, text string")
    rows = spark.createDataFrame([(1, 0, ["2600"]), (1, 1, ["2.6", "2600"]), (1, 0, ["9"]), (1, 0, []), (2, 0, ["1"]), (3, 0, ["1"])], "doc long, page long, forms array<string>")
    assert sorted((r["doc"], r["page"], r["status"], r["other_pages"]) for r in consistency.verified_on_page(rows, pages).collect()) == sorted([
        (1, 0, "found on cited page", ""), (1, 1, "found on other page(s)", "0"), (1, 0, "NOT FOUND in text", ""), (1, 0, "unverifiable", ""), (2, 0, "no text layer", ""), (3, 0, "no text layer", ""),
    ])
