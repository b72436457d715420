"""Expressions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from attestor.functions import names, text
from attestor.functions import text as tx
from attestor.functions import values as vl


@pytest.mark.parametrize("a,b,same", [(100.0, 98.0, True), (100.0, 97.9, False), (0.0, 0.0, True), (-1.0, 1.0, False)])
def test_close_is_relative_to_the_larger(spark, a, b, same):
    assert spark.range(1).select(vl.close(F.lit(a), F.lit(b))).first()[0] is same


@pytest.mark.parametrize("a,b,same", [(0.65, 0.65, True), (0.65, 0.75, True), (1.0, 1.2, True), (1.0, 1.3, False), (0.2, 5.0, False), (None, 1.0, False), (1.0, None, False)])
def test_comparable_currents(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a double, b double").select(vl.comparable(F.col("a"), F.col("b"))).first()
    assert row[0] is same


def test_values_match_scales_sorts_and_counts(spark):
    rows = [([3350.0], "mAh", [3.35], "Ah", True), ([4.0, 2.0], "V", [2.0, 4.0], "V", True), ([1.0], "A", [1.0, 2.0], "A", False), ([], "A", [], "A", False), (None, "A", [1.0], "A", False)]
    df = spark.createDataFrame(rows, "a array<double>, au string, b array<double>, bu string, want boolean")
    got = df.select(vl.values_match(F.col("a"), F.col("au"), F.col("b"), F.col("bu")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_thousandfold_only_for_small_and_large(spark):
    df = spark.createDataFrame([([3350.0], 3.35, True), ([1.0], 999.0, False), ([1.5], 1500.0, True), ([-20.0], 20.0, True), ([], 1.0, False)], "d array<double>, x double, want boolean")
    got = df.select(vl.in_numbers(F.col("x"), F.col("d")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_numbers_repair_separators_but_raw_ones_do_not(spark):
    df = spark.createDataFrame([("1,000 cycles at −20 and 12,345,678 or 1,23",)], "t string")
    r = df.select(tx.numbers(F.col("t")).alias("a"), tx.raw_numbers(F.col("t")).alias("b")).first()
    assert r["a"] == [1000.0, -20.0, 12345678.0, 1.0, 23.0]
    assert r["b"][0] == 1.0


@pytest.mark.parametrize("text,want", [("Max. 47.5g", "upper"), ("at least 3", "lower"), ("45 min", None), ("45min charge", None), ("min. 5", "lower"), ("up to 5, min 2", "upper"), ("plain", None)])
def test_bounds(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.bound(F.col("t"))).first()[0] == want


def test_policies(spark):
    df = spark.createDataFrame([("3.6C(80%)-3.6C",), ("bad",), (None,)], "p string")
    got = [r[0] for r in df.select(tx.policy_parts(F.col("p"))).collect()]
    assert (got[0]["c1"], got[0]["soc"], got[0]["c2"]) == (3.6, 80.0, 3.6) and got[1] is None and got[2] is None
    assert spark.createDataFrame([(" 4C-newstructure ",)], "p string").select(tx.policy_name(F.col("p"))).first()[0] == "4C"


def test_answers(spark):
    rows = [("It is 3350 mAh", [3.35], "Ah", "correct"), ("It is 3350 Ah", [3.35], "Ah", "unit_confused"), ("It is 2.9 Ah", [3.35], "Ah", "wrong"), ("No idea", [3.35], "Ah", "no_value"), ("2.5 to 4.2 V", [2.5, 4.2], "V", "correct")]
    df = spark.createDataFrame(rows, "a string, g array<double>, u string, want string")
    assert all(r[0] == r[1] for r in df.select(tx.score_value(F.col("a"), F.col("g"), F.col("u")), "want").collect())
    hedged = spark.createDataFrame([("I don't know", True), ("approximately 3", True), ("3 Ah", False)], "a string, want boolean")
    assert all(r[0] == r[1] for r in hedged.select(tx.hedges(F.col("a")), "want").collect())


def test_source_keys_prefer_the_best_identifier(spark):
    df = spark.createDataFrame([("10.1/AB", "2401.1", "T"), (None, "2401.1V2", "T"), (None, None, "A  Title!"), ("", " ", "a title")], "d string, a string, t string")
    got = [r[0] for r in df.select(tx.source_key(F.col("d"), F.col("a"), F.col("t"))).collect()]
    assert got[:2] == ["doi:10.1/ab", "arxiv:2401.1v2"] and got[2] == got[3] and got[2].startswith("title:") and len(got[2]) == 22


def test_json_blocks_and_triage(spark):
    df = spark.createDataFrame([("```json\nSure: [1, [2]] ok\n```",), ("none",), ("]x[",)], "r string")
    assert [r[0] for r in df.select(tx.json_block(F.col("r"), "[", "]")).collect()] == ["[1, [2]]", None, None]
    t = spark.createDataFrame([("YES:  a\n b",), ("perhaps",)], "r string").select(tx.triage(F.col("r")).alias("t")).select("t.*").collect()
    assert [tuple(x) for x in t] == [("yes", "a b"), ("unparsed", "perhaps")]


def test_html_and_sentences(spark):
    df = spark.createDataFrame([('<ul><li>One  a<li><b>Two</b></ul><p>End. Next! <img src="x">Last</p>',)], "h string")
    assert df.select(tx.list_items(F.col("h"))).first()[0] == ["One a", "Two"]
    assert df.select(tx.sentences(tx.html_text(F.col("h")))).first()[0][-3:] == ["End.", "Next!", "Last"]


def test_quantities(spark):
    df = spark.createDataFrame([("3.35 Ah", True), ("-20°C", True), ("≥ 5", False), ("about 5", False), ("", False)], "c string, want boolean")
    assert all(r[0] == r[1] for r in df.select(tx.is_quantity(F.col("c")), "want").collect())


def test_cells_and_regions(spark):
    """Which cells are bare quantities, what kind a region is and how it reads."""
    yes = ["-20℃", "0.50A", "100%", "2,500mAh", "1,234,567 mAh", "−20 °C", "4.2 v", "25 ", "3 cycles"]
    no = ["", None, "<5", "CCCV, 1.25A", "4.20 ± 0.05 V", "abc", "12 x"]
    cells = spark.createDataFrame([(c,) for c in yes + no], "c string")
    assert [r["q"] for r in cells.select(text.is_quantity(F.col("c")).alias("q")).collect()] == [True] * len(yes) + [False] * len(no)
    regions = [[["T", "0 °C", "25 °C"], ["C", "90%", "100%"]], [["a", "b"]] * 4, [["a", "1"]] * 3, [["a", "b\n c"], ["d"]]]
    got = spark.createDataFrame([(r,) for r in regions], "r array<array<string>>").select(names.region_kind(F.col("r")).alias("k"), names.rendered(F.col("r")).alias("t")).collect()
    assert [r["k"] for r in got] == ["grid", "spec_table", "other", "other"] and got[3]["t"] == "| a | b c |\n| d |  |"


def test_names_of_grid_cells(spark):
    cases = [("temperature_c", "-20", "m20c"), ("temperature_c", "0", "0c"), ("current_a", "0.50", "0_5a"), ("current_a", "20.0", "20a"), ("charge_mode", " Rapid ", "rapid")]
    df = spark.createDataFrame(cases, "kind string, value string, token string")
    assert all(r["t"] == r["token"] for r in df.select("token", names.axis_token(F.col("kind"), F.col("value")).alias("t")).collect())
    name = lambda f, k, v: spark.range(1).select(names.property_name(F.lit(f), F.lit(k), F.lit(v)).alias("n")).first()["n"]
    assert name("rel_capacity", "temperature_c", "-10") == "rel_capacity_m10c_pct" and name("rel_charge_capacity", "charge_mode", "std") == "rel_charge_capacity_std_charge_pct"
    for bad in (("other", "current_a", "1"), ("rel_capacity", "humidity", "1"), ("rel_capacity", "charge_mode", "slow")):
        with pytest.raises(Exception, match="unknown"):
            name(*bad)


def test_sections_printed_forms_and_triage(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    said = {"3.12 Storage: cool": "§3.12 Storage", "4": "§4", "'2.1 Scope' of": "§2.1 Scope' of", "none": "—"}
    assert {t: one(names.section(F.lit(t))) for t in said} == said
    forms = lambda v, u: set(one(names.printed_forms(F.lit(v), F.lit(u))))
    assert forms(0.05, "A") == {"0.05", "50"} and forms(45.0, "g") == {"45", "45.0"} and forms(2.0, "Ah") == {"2", "2000", "2.0"} and forms(1e6, "g") == {"1e+06", "1000000", "1000000.0"}
    reply = lambda t: tuple(one(text.triage(F.lit(t))))
    assert reply("yes - good  data") == ("yes", "good data") and reply(" No: x") == ("no", "x") and reply("maybe – y") == ("maybe", "y")
    assert reply("  well " + "z" * 300) == ("unparsed", ("well " + "z" * 300)[:200]) and reply("yes:")[0] == "unparsed"
