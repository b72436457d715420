"""Operators on small inline rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor import schemas
from attestor.operators import claims, gate, graph, matching, models, series, stats, store


def fade(spark, n=150, start=1.1, step=0.001):
    return spark.createDataFrame([("a", i, start - step * i) for i in range(1, n + 1)], "cell string, cycle long, cap double")


def test_conform_orders_types_and_refuses(spark):
    rows = spark.createDataFrame([("b", "s", 2, 1.0), ("a", "s", 1, float("nan"))], "cell_id string, study string, cycle_index int, discharge_capacity_ah double")
    assert schemas.conform(rows).columns == schemas.CYCLES.names
    with pytest.raises(Exception, match="null in required column"):
        schemas.conform(rows).collect()
    assert schemas.conform(rows.where("cell_id = 'b'")).first()["chemistry"] is None
    with pytest.raises(schemas.ContractError, match="study"):
        schemas.conform(rows.drop("study"))


def test_life_interpolates_and_accepts_the_end(spark):
    life = series.lives(fade(spark, 400), "cell", "cycle", "cap").first()
    # initial 1.1 - .003 = 1.097; threshold .8776 is met at cycle 222.4
    assert life["init"] == pytest.approx(1.097) and life["life"] == pytest.approx(222.4, abs=1e-6)
    assert life["flags"] == "" and not life["anomalous"]
    near_end = series.lives(fade(spark, 220), "cell", "cycle", "cap").first()
    assert near_end["life"] == 220.0  # .880 is within one per cent of the threshold
    short = series.lives(fade(spark, 40), "cell", "cycle", "cap", F.lit(2.5)).first()
    assert short["flags"] == "short_series,low_initial_capacity" and short["anomalous"] and short["life"] == 1.0  # starts below


def test_crossing_at_the_first_cycle_and_flat_brackets(spark):
    rows = spark.createDataFrame([("a", 1, 0.5, 0.8), ("a", 2, 0.4, 0.8), ("b", 1, 0.9, 0.8), ("b", 2, 0.8, 0.8), ("c", 1, 0.9, 0.8)], "e string, n long, v double, t double")
    got = {r["e"]: r["crossing"] for r in series.crossing(rows, "e", "n", "v", "t").collect()}
    assert got == {"a": 1.0, "b": 2.0}


def test_early_features(spark):
    f = series.early_features(fade(spark), "cell", "cycle", "cap").first()
    assert (f["slope"], f["at_lo"], f["at_hi"]) == (pytest.approx(-0.001), pytest.approx(1.098), pytest.approx(1.0))
    assert f["ratio"] == pytest.approx(1.0 / 1.098)
    d = spark.createDataFrame([([0.0] * 5, [-0.02, -0.01, 0.0, 0.01, 0.02])], "a array<double>, b array<double>")
    c = series.curve_difference(d, "a", "b").first()
    assert c["var_difference"] == pytest.approx(math.log10(2e-4)) and c["min_difference"] == pytest.approx(math.log10(0.02))


def test_runs_and_continuations(spark):
    t = spark.createDataFrame([("a", x) for x in (0.0, 10.0, 100.0, 110.0, 120.0)], "e string, t double")
    runs = series.gap_runs(t, "e", F.col("t"), 60.0)
    assert series.longest_run(runs, "e").first() == ("a", 1, 3)
    s = spark.createDataFrame([("a", 2, 1.0), ("a", 3, 2.0), ("b", 1, 9.0), ("b", 2, 8.0)], "e string, n long, v double")
    links = spark.createDataFrame([("a", "b")], "entity string, next string")
    got = sorted((r["n"], r["v"]) for r in series.continued(s, "e", "n", links).collect())
    assert got == [(2, 1.0), (3, 2.0), (4, 8.0)]  # b's first row would be cycle 3 again, where a's stays


def vectors(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [0.0, 0.0]), (4, 1, [5.0, 0.0])]
    return spark.createDataFrame(rows, "id long, grp int, vec array<double>")


def test_twins_are_kept_unless_they_are_the_query(spark):
    v = vectors(spark)
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.nearest(v, v, 2).collect()}
    assert got[1, 3] == 1.0 and got[3, 1] == 1.0 and (1, 1) not in got and got[1, 2] == 0.5
    other = {(r["src"], r["dst"]) for r in graph.nearest(v, v, 3, exclude_group=True).collect()}
    assert (1, 2) not in other and (1, 4) in other


def test_blocks_give_the_same_neighbours(spark, monkeypatch):
    v = vectors(spark)
    whole = sorted(map(tuple, graph.nearest(v, v, 2).collect()))
    monkeypatch.setattr(graph, "BLOCK", 1)
    assert sorted(map(tuple, graph.nearest(v, v, 2).collect())) == whole


@pytest.mark.parametrize("exclude_group", [False, True])
def test_cells_give_the_same_neighbours_as_all_pairs(spark, monkeypatch, exclude_group):
    """Many cells, copies beyond k, a group of its own far away, two draws, and queries outside the bank."""
    for name, value in {"BLOCK": 40, "CELL": 8, "SAMPLE": 50, "SAMPLE_BOUND": 20}.items():
        monkeypatch.setattr(graph, name, value)
    rng = np.random.default_rng(3)
    rows = [(d, i, int(i % 4), [float(x) for x in rng.normal(size=3)]) for d in (0, 1) for i in range(150)]
    rows += [(0, 200 + i, i % 3, [0.5, 0.5, 0.5]) for i in range(30)] + [(1, 300 + i, 9, [50.0 + i, 0.0, 0.0]) for i in range(20)]
    table = spark.createDataFrame(rows, "draw int, id long, grp int, vec array<double>")
    queries, bank = table.where("id % 5 <> 1"), table.where("id % 5 <> 2")
    got = sorted(map(tuple, graph.nearest(queries, bank, 4, exclude_group=exclude_group, within="draw").select("draw", "src", "dst", "weight", "same_group").collect()))
    want = []
    for d, i, g, v in (r for r in rows if r[1] % 5 != 1):
        near = [(-1 / (1 + float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum()))), j, h == g) for e, j, h, w in rows if e == d and j != i and j % 5 != 2 and not (exclude_group and h == g)]
        want += [(d, i, j, -w, same) for w, j, same in sorted(near)[:4]]
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in sorted(want)] and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)])


def test_most_cells_are_not_searched(spark, monkeypatch):
    """Of 64 cells along a line a query's k nearest rows lie in few."""
    for name, value in {"BLOCK": 100, "CELL": 100}.items():
        monkeypatch.setattr(graph, name, value)
    visits, searched = [], graph._searched
    monkeypatch.setattr(graph, "_searched", lambda v, *rest: visits.append(v.count()) or searched(v, *rest))
    v = spark.range(6_400).selectExpr("id", "cast(id % 3 as int) as grp", "array(cast(id as double), 0D) as vec")
    assert graph.nearest(v, v, 3).count() == 19_200 and visits[0] < 3 * 6_400


def test_zscore_of_a_constant_is_zero(spark):
    z = graph.zscored(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in z] == [(-1.0, 0.0), (1.0, 0.0)]


def test_neighbour_statistics(spark):
    e = spark.createDataFrame([(3, 1, 0.8), (3, 2, 0.7)], "src long, dst long, weight double")
    y = spark.createDataFrame([(1, 2.5), (2, 2.9)], "id long, y double")
    r = graph.neighbour_statistics(e, y).first()
    mean = (0.8 * 2.5 + 0.7 * 2.9) / 1.5
    assert r["nbr_mean"] == pytest.approx(mean) and r["coverage"] == pytest.approx(1.5)


def test_risk_falls_with_coverage(spark):
    rows = spark.createDataFrame([(float(i), 100.0 - i) for i in range(50)], "coverage double, square double")
    curve = gate.risk_coverage(rows, "coverage", "square").orderBy("threshold").collect()
    assert curve[0]["n_retained"] == 50 and all(a["rmse_retained"] >= b["rmse_retained"] for a, b in zip(curve, curve[1:], strict=False))
    flat = spark.createDataFrame([(0.2, 3.0), (1.0, 3.0)], "frac_retained double, rmse_retained double")
    assert gate.area(flat).first()[0] == pytest.approx(3.0)


def test_alpha_and_kappa(spark):
    codings = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert stats.alpha(codings, "x", "y").first()["alpha"] == 0.533
    one = spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string")
    assert stats.alpha(one, "x", "y").first()["alpha"] is None and stats.kappa(one, "x", "y").first()["kappa"] is None
    assert stats.alpha(codings.where("false"), "x", "y").first()["alpha"] is None


def test_ranks_share_ties_over_any_partitions(spark):
    rows = spark.createDataFrame([(x,) for x in (3.0, 1.0, 2.0, 2.0, 5.0)], "v double")
    got = sorted((r["v"], r["r"]) for r in stats.average_ranks(rows, "v", "r").collect())
    assert got == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (3.0, 4.0), (5.0, 5.0)]


def test_kaplan_meier(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (4.0, 1)], "t double, e int")
    got = [(r["t"], r["n_risk"], round(r["survival"], 6)) for r in stats.kaplan_meier(rows, "t", "e").orderBy("t").collect()]
    assert got == [(0.0, 4, 1.0), (1.0, 4, 0.75), (3.0, 2, 0.375), (4.0, 1, 0.0)]
    assert stats.median_survival(stats.kaplan_meier(rows, "t", "e")).first()[0] == 3.0


def test_verdicts(spark):
    none, cond = {}, lambda c: {"discharge_c_rate": c}
    rows = [
        ([3.35], none, "", [3.4], none, "", "consistent"), ([4.0], none, "", [5.0], none, "", "document_variant_conflict"), ([1000.0], cond(5.0), "", [1000.0], cond(10.0), "", "condition_mismatch"),
        ([0.0, 45.0], none, "", [45.0, 0.0], none, "", "consistent"), ([47.5], none, "Max. 47.5g", [45.0], none, "45", "consistent"), ([47.5], none, "Max. 47.5", [45.0], none, "Max. 45", "document_variant_conflict"),
    ]
    m = "map<string,double>"
    df = spark.createDataFrame(rows, f"a array<double>, ac {m}, at string, b array<double>, bc {m}, bt string, want string")
    got = df.select(claims.verdict(*map(F.col, ("a", "ac", "at", "b", "bc", "bt"))).alias("v"), "want").collect()
    assert [r["v"] for r in got] == [r["want"] for r in got]


def test_validation_stages(spark):
    docs = spark.createDataFrame([("d", "Capacity 3,350 mAh, weight 47.5 ± 1.5 g, 5000 g")], "doc string, text string")
    made = [("d", "nominal_capacity_ah", "3350", "mAh"), ("d", "mass_g", "[46.0, 49.0]", "g"), ("d", "mass_g", "5000", "g"), ("d", "mass_g", "61", "g"), ("d", "mass_g", '"x"', "g"), ("d", None, "1", "g"), ("d", "other", "[[3350,47.5],[1.5,5000]]", None)]
    out = claims.validated(spark.createDataFrame(made, "doc string, property string, value string, unit string"), docs, "doc", "text").collect()
    by = {(r["property"], r["value"]): r for r in out}
    assert by["nominal_capacity_ah", "3350"]["reason"] is None
    assert by["mass_g", "[46.0, 49.0]"]["reason"] in (None, "value_not_in_source")
    assert by["mass_g", "5000"]["reason"] == "implausible" and by["mass_g", "61"]["reason"] == "value_not_in_source"
    assert by["mass_g", '"x"']["reason"] == "malformed_value" and by[None, "1"]["reason"] == "missing_field"
    assert sum(r["property"] == "other" and r["reason"] is None for r in out) == 2


def test_tolerance(spark):
    rows = spark.createDataFrame([([46.0, 49.0], "47.5 ± 1.5"), ([46.0, 50.0], "47.5 ± 1.5"), ([47.5], "47.5 ± 1.5")], "v array<double>, t string")
    from attestor.functions import text as tx

    out = claims.with_tolerance(rows.withColumn("pm", tx.plus_minus(F.col("t"))), "v", "pm").collect()
    assert [(r["v"], r["normalized"]) for r in out] == [([47.5], True), ([46.0, 50.0], False), ([47.5], False)]


def test_greedy_pairs_and_gold_order(spark):
    a = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 20.0)], "k string, pos long, value double")
    b = spark.createDataFrame([("k", 1, 19.0), ("k", 2, 90.0), ("z", 1, 1.0)], "k string, pos long, value double")
    got = {(r["k"], r["i"], r["j"]) for r in matching.greedy_pairs(a, b, ["k"], "value").collect()}
    assert got == {("k", 2, 1), ("k", 1, 2), ("z", None, 1)}
    gold = matching.gold_order(a, spark.createDataFrame([("k", 1, 10.1), ("k", 2, 10.0)], "k string, pos long, value double"), ["k"]).collect()
    assert {(r["g"], r["p"]) for r in gold} == {(1, 1), (2, None)}


def test_consensus_compares_with_the_first_only(spark):
    rows = [("k", 1, 1, 100.0), ("k", 2, 1, 101.9), ("k", 3, 1, 103.8), ("k", 1, 2, 5.0)]
    got = matching.consensus(spark.createDataFrame(rows, "k string, run long, pos long, value double"), ["k"]).collect()
    assert [(r["run"], r["value"], r["level"]) for r in got] == [(1, 100.0, 2)]


def test_field_majority(spark):
    rows = [("k", 1, "t", "25"), ("k", 2, "t", " 25 "), ("k", 3, "t", "20"), ("k", 1, "u", "unspecified"), ("k", 2, "u", "x")]
    got = matching.field_majority(spark.createDataFrame(rows, "k string, run long, field string, value string"), ["k"]).collect()
    assert [(r["field"], r["value"], r["n"]) for r in got] == [("t", "25", 2)]
    rows = [("k", 1, "t", "1 A"), ("k", 2, "t", "2 A"), ("k", 3, "t", "1.0 A"), ("k", 1, "u", "a or b"), ("k", 2, "u", "A or B "), ("k", 1, "v", "3 to 4"), ("k", 2, "v", "4 to 3")]
    got = matching.field_majority(spark.createDataFrame(rows, "k string, run long, field string, value string"), ["k"]).collect()
    assert sorted((r["field"], r["value"], r["n"]) for r in got) == [("t", "1 A", 2), ("u", "a or b", 2), ("v", "3 to 4", 2)]


def test_life_of_series_with_odd_values(spark):
    """NaN and infinity count as missing and as non-finite, and don't make a healthy cell look too large."""
    rows = [("a", n, {20: float("nan"), 30: float("inf"), 40: None}.get(n, 1.1 - 0.001 * n)) for n in range(1, 400)]
    got = series.lives(spark.createDataFrame(rows, "cell string, cycle long, q double"), "cell", "cycle", "q", F.lit(1.1)).first()
    assert (got["odd"], got["flags"]) == (3, "non_finite_capacity") and abs(got["top"] - 1.099) < 1e-9 and 218 <= got["life"] <= 222


def test_running_totals_and_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400), strict=True)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r for r in stats.quantiles(df, "v", {"a": 0.0, "b": 0.41, "c": 1.0}, "g").collect()}
    for g in range(3):
        own = [v for k, v in rows if k == g]
        assert got[g]["n"] == len(own) and np.allclose([got[g][c] for c in "abc"], np.percentile(own, [0, 41, 100]))
    whole = stats.quantiles(df, "v", {"m": 0.5}).first()
    assert abs(whole["m"] - np.median([v for _, v in rows])) < 1e-9
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    down = {r["v"]: r["t"] for r in stats.running_totals(counts, "v", {"t": "n"}, descending=True).collect()}
    assert all(t == sum(x >= v for _, x in rows) for v, t in down.items())


def test_bootstrap_of_the_area(spark):
    """The point is the curve's own area, the interval encloses the folds' spread, and equal errors give one flat curve."""
    rows = [(i % 5, float(i), 4.0 if i % 5 == 0 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "fold long, c double, s double")
    got = gate.bootstrap_area(df, "c", "s", replicates=40).first()
    assert abs(got["point"] - gate.area(gate.risk_coverage(df, "c", "s")).first()["aurc"]) < 1e-9
    assert got["n"] == 40 and 1.0 <= got["lo"] < got["point"] < got["hi"] <= 2.0
    flat = gate.bootstrap_area(df.withColumn("s", F.lit(9.0)), "c", "s", replicates=10).first()
    assert abs(flat["lo"] - 3) < 1e-9 and abs(flat["hi"] - 3) < 1e-9 and abs(flat["point"] - 3) < 1e-9


def test_query_features_use_the_bank(spark):
    """A foreign query is scaled by the bank alone, and a twin counts unless it is the query itself."""
    bank = spark.createDataFrame([(i, i % 2, float(i), float(i)) for i in range(10)], "id long, grp long, a double, y double")
    one = spark.createDataFrame([(77, 5, 3.0), (4, 0, 4.0)], "id long, grp long, a double")
    got = {r["id"]: r for r in graph.query_features(one, bank, ["a"], k=1).collect()}
    more = one.unionByName(spark.createDataFrame([(78, 5, 1000.0)], one.schema))
    again = {r["id"]: r for r in graph.query_features(more, bank, ["a"], k=1).collect()}
    assert got[77]["nbr_mean"] == 3.0 and got[77]["coverage"] == 1.0 and again[77] == got[77] and again[78]["nbr_mean"] == 9.0
    assert got[4]["nbr_mean"] == 3.0 and got[4]["coverage"] < 1.0


def test_nearest_equals_plain_search(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(graph, "BLOCK", 40)
    rng = np.random.default_rng(9)
    x = rng.integers(-4, 5, size=(130, 3)).astype(float)
    x[5] = x[6]
    rows = [(i, i % 4, x[i].tolist()) for i in range(130)]
    v = spark.createDataFrame(rows, "id long, grp long, vec array<double>")
    got = {}
    for r in graph.nearest(v, v, 4, exclude_group=True).collect():
        got.setdefault(r["src"], []).append((-r["weight"], r["dst"]))
    for i in range(130):
        d = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 12), j) for j in range(130) if j % 4 != i % 4)[:4]
        assert [j for _, j in d] == [j for _, j in sorted(got[i])]


def test_logrank_test(spark):
    rows = [(float(t), 1, "a") for t in (1, 2, 3, 4, 5)] + [(float(t), 1, "b") for t in (4, 6, 8, 9, 10)]
    got = stats.logrank_test(spark.createDataFrame(rows, "t double, e int, g string"), "t", "e", "g").first()
    at = [(1, 5, 5, 1, 1), (2, 4, 5, 1, 1), (3, 3, 5, 1, 1), (4, 2, 5, 2, 1), (5, 1, 4, 1, 1), (6, 0, 4, 1, 0), (8, 0, 3, 1, 0), (9, 0, 2, 1, 0)]
    o, e, v = 5, sum(d * a / (a + b) for _, a, b, d, _ in at), sum(d * (a + b - d) / (a + b - 1) * a * b / (a + b) ** 2 for _, a, b, d, _ in at)
    assert abs(got["chi2"] - (o - e) ** 2 / v) < 1e-9
    import math

    assert abs(got["p"] - math.erfc(math.sqrt(got["chi2"] / 2))) < 1e-6


def test_stitching_takes_pairs_from_the_left(spark):
    rows = [("d", 1, 3, 1, False), ("d", 2, 3, 1, False), ("d", 3, 3, 1, False), ("d", 4, 3, 2, False), ("d", 6, 3, 1, False)]
    got = sorted((r["first"], r["last"]) for r in matching.stitched(spark.createDataFrame(rows, "doc string, page long, n_cols int, n_quantity int, has_free boolean"), "doc", "page").collect())
    assert got == [(1, 2), (3, 3), (4, 4), (6, 6)]
    rows = [("d", 1, 1, 3, 1, False), ("d", 1, 2, 3, 2, False), ("d", 2, 1, 3, 1, False), ("d", 2, 2, 3, 1, False), ("d", 3, 1, 3, 1, False)]
    many = spark.createDataFrame(rows, "doc string, page long, at int, n_cols int, n_quantity int, has_free boolean")
    assert sorted((r["first"], r["last"]) for r in matching.stitched(many, "doc", "page", "at").collect()) == [(1, 1), (1, 1), (2, 2), (2, 3)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k long, v string, s string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "k long, v string, s string")
    once = store.upsert(old, new, "k", keep_old=["s"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    assert sorted(map(tuple, store.upsert(once, new, "k", keep_old=["s"]).collect())) == sorted(map(tuple, once.collect()))


def test_trees_and_gate(spark):
    rows = spark.createDataFrame([(i, i % 4, float(i), None if i % 7 == 0 else float(i % 5), 2.0 * i) for i in range(60)], "id long, grp int, a double, b double, y double")
    data, columns = models.with_indicators(rows, ["a", "b"])
    cv = models.cross_validated(models.grouped_folds(data, "grp", 2), columns, "y", 2, rounds=5).withColumn("coverage", F.col("a") / 60)
    assert cv.count() == 60
    band = models.residual_band(cv, "y", "coverage", 2)
    out = models.gated(cv, "coverage", 0.5, band).collect()
    assert sum(r["abstain"] for r in out) == 30 and all((r["value"] is None) == r["abstain"] and (r["abstain"] or r["low"] <= r["high"]) for r in out)
