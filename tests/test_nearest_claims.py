"""Nearest rows, prefixes and causes against plain searches."""

import random

from pyspark.sql import functions as F

from attestor.functions.values import values_match
from attestor.operators import nearest_claims


def test_nearest_rows(spark):
    """Ties in value and distance, missing values, keys without rows or without values."""
    rng = random.Random(15)
    value = lambda: rng.choice([None, *[float(x) for x in range(12)], 2.5])
    left = [(f"k{rng.randrange(6)}", i, value()) for i in range(150)] + [("none", 900, 1.0), (None, 901, 1.0)]
    right = [(f"k{rng.randrange(5)}", 1000 - i, value()) for i in range(60)] + [("k5", 7, None), ("k5", 3, None)]
    got = {r["id"]: r["pos"] for r in nearest_claims.nearest_rows(spark.createDataFrame(left, "k string, id long, value double"), spark.createDataFrame(right, "k string, pos long, value double"), ["k"]).collect()}
    for k, i, v in left:
        own = [(p, x) for key, p, x in right if key == k and k is not None]
        known = [(p, x) for p, x in own if x is not None]
        want = min(known, key=lambda r: (abs(r[1] - v), r[0]))[0] if known and v is not None else min((p for p, _ in known or own), default=None)
        assert got[i] == want, (k, i, v)
    assert len(got) == len(left)


def test_claim_conditions(spark):
    claims = spark.createDataFrame(
        [("a", 0, [1.0, 2.0], 1.0, {"x": 1.0}, None), ("a", 1, [3000.0], 0.001, {"x": None, "retention_pct": 5.0}, "until 80 % remain"), ("b", 0, [1.0, 9.0], 1.0, {"x": 4.0}, None)],
        "k string, pos long, value array<double>, unit_factor double, conditions map<string,double>, end_condition string",
    )
    asked = spark.createDataFrame([(1, "a", 2.0), (2, "b", 5.0), (3, "c", 5.0)], "id long, k string, value double")
    assert {r["id"]: r["conditions"] for r in nearest_claims.claim_conditions(asked, claims, ["k"]).collect()} == {1: {"retention_pct": 80.0}, 2: {"x": 4.0}, 3: {}}


def test_prefixes(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, ""), (4, None), (5, "x\U0001f600"), (6, "toolong")], "id long, prefix string")
    lines = spark.createDataFrame([("abd",), (None,), ("x\U0001f600y",), ("tool",)], "line string")
    assert {r["id"] for r in nearest_claims.beginning_with(rows, "prefix", lines, "line").collect()} == {1, 3, 5}
    assert nearest_claims.beginning_with(rows, "prefix", lines.where("false"), "line").count() == 0


def test_causes(spark):
    gold = spark.createDataFrame([(1, "a", [1.0], "V", [9.0]), (2, "a", [1.0], "V", [1.0]), (3, "b", [1.0], "V", [1.0]), (4, "b", [2.0], "V", [2.0]), (5, "c", [2.0], "V", [2.0])], "id long, property string, value array<double>, unit string, n array<double>")
    proposed = spark.createDataFrame([(1, "a", [1000.0], "mV"), (2, "a", [1.0], "V"), (2, "b", [1.01], "V"), (1, "b", [7.0], "V")], "run int, property string, p_value array<double>, p_unit string")
    rejected = spark.createDataFrame([("a", "implausible"), ("a", "implausible"), ("z", "x")], "property string, reason string")
    match = values_match(F.col("value"), F.col("unit"), F.col("p_value"), F.col("p_unit"))
    got = {r["id"]: (r["cause"], r["detail"]) for r in nearest_claims.missed_causes(gold, proposed, rejected, F.col("n"), match).collect()}
    assert got == {
        1: ("ocr_value_lost", ""), 2: ("validator_rejected", "runs 1,2: implausible"), 3: ("consensus_dropped", "runs 2"), 4: ("wrong_value", "values 1.01,7.0"), 5: ("not_extracted", ""),
    }


def test_causes_compare_equal_claims_once(spark):
    """A thousand claims of two kinds and three proposals are six comparisons; claims without a unit or value count too."""
    compared = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def same(value, p_value):
        compared.add(1)
        return value == p_value

    gold = spark.range(1000).selectExpr("id", "'a' as property", "if(id % 2 = 0, array(1d), null) as value", "cast(null as string) as unit", "array(1d) as n")
    proposed = spark.createDataFrame([(n, "a", [float(n)], "V") for n in (1, 2, 3)], "run int, property string, p_value array<double>, p_unit string")
    rejected = spark.createDataFrame([], "property string, reason string")
    got = nearest_claims.missed_causes(gold, proposed, rejected, F.col("n"), same(F.col("value"), F.col("p_value"))).groupBy("cause", "detail").count().collect()
    assert {tuple(r) for r in got} == {("consensus_dropped", "runs 1", 500), ("wrong_value", "values 1.0,2.0,3.0", 500)} and compared.value == 6


def test_recall(spark):
    gold = spark.createDataFrame([("a", "V", 1.0, 0), ("a", "mV", 1000.0, 1), ("b", "A", 3.0, 2)], "property string, unit string, value double, pos long")
    said = spark.createDataFrame([("a", "V", 1.0, 0), ("z", "mA", 3000.0, 1), ("y", "V", 1.01, 2)], "property string, unit string, value double, pos long")
    one = lambda exact: tuple(nearest_claims.subset_recall(gold, said, exact).first())
    assert one(True) == (3, 1, 0.3333) and one(False) == (3, 3, 1.0)
    assert tuple(nearest_claims.subset_recall(gold.where("false"), said, True).first()) == (0, 0, 0.0)
