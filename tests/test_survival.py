"""Log-rank tests of k groups and intervals over drawn folds, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import gate, stats


def plain_logrank(rows):
    time, event, group = (np.array(x) for x in zip(*rows, strict=True))
    groups = np.unique(group)
    k = len(groups)
    observed, expected, v = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for t in np.unique(time[event == 1]):
        n, d = (time >= t).sum(), ((time == t) & (event == 1)).sum()
        if n > 1:
            own = np.array([((time >= t) & (group == g)).sum() for g in groups], float)
            observed += [((time == t) & (event == 1) & (group == g)).sum() for g in groups]
            expected += own * d / n
            v += d * (n - d) / (n - 1) / n**2 * (np.diag(own * n) - np.outer(own, own))
    z = (observed - expected)[:-1]
    return observed, expected, v, float(z @ np.linalg.pinv(v[:-1, :-1]) @ z)


@pytest.mark.parametrize("k", [2, 3, 7])
def test_logrank_of_k_groups(spark, monkeypatch, k):
    rng = random.Random(k)
    rows = [(float(rng.randrange(1, 40) + 3 * (g == 1)), int(rng.random() < 0.6), f"g{g}") for g in range(k) for _ in range(30)]
    df = spark.createDataFrame([*rows, (None, 1, "g0"), (5.0, 1, None)], "t double, e int, g string")
    observed, expected, v, chi2 = plain_logrank(rows)
    for one_task in (100_000, 0):
        monkeypatch.setattr(stats, "ONE_TASK", one_task)
        groups, o, e, w = stats.logrank_sums(df, "t", "e", "g")
        assert groups == [f"g{i}" for i in range(k)] and o == pytest.approx(observed) and e == pytest.approx(expected) and w == pytest.approx(v)
        r = stats.logrank_test(df, "t", "e", "g").first()
        assert (r["groups"], r["df"]) == (k, k - 1) and r["chi2"] == pytest.approx(chi2)
    if k == 2:
        one = stats.logrank_pairs(df, "t", "e", "g").first()
        assert one["chi2"] == pytest.approx(chi2) and one["p"] == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))


def test_logrank_needs_two_groups(spark):
    r = stats.logrank_test(spark.createDataFrame([(1.0, 1, "a")], "t double, e int, g string"), "t", "e", "g").first()
    assert (r["groups"], r["chi2"], r["p"]) == (1, None, None)
    assert stats.logrank_test(spark.createDataFrame([], "t double, e int, g string"), "t", "e", "g").first()["groups"] == 0


def test_chi_square_tail():
    for x in (0.01, 0.5, 3.0, 40.0, 300.0):
        assert stats.chi_square_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
        assert stats.chi_square_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-9)
        assert stats.chi_square_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-9)
    assert stats.chi_square_tail(0.0, 5) == 1.0 and stats.chi_square_tail(180.95, 2) == pytest.approx(5.1e-40, rel=0.02)


def trapezoids(points, lo=0.2, hi=1.0, n=161):
    x, y = zip(*sorted(points), strict=True)
    grid = np.linspace(lo, hi, n)
    return float(np.trapezoid(np.interp(grid, x, y), grid) / (hi - lo))


def test_intervals_over_folds(spark):
    """Points and replicates of both gates from the drawn folds, row by row."""
    rng = random.Random(12)
    rows = [(f"f{i % 5}", i, round(rng.random(), 2), round(rng.random(), 2), rng.random() * 9) for i in range(120)]
    df = spark.createDataFrame(rows, "fold string, id long, coverage double, spread double, square double").cache()
    times = {}
    for r in gate.drawn_folds(df.select("fold").distinct(), 40, 3).collect():
        times.setdefault(r["rep"], {})[r["fold"]] = r["times"]
    assert len(times) == 40 and all(sum(t.values()) == 5 for t in times.values())

    def curve(weight):
        total = sum(weight(r[0]) for r in rows)
        out = []
        for t in sorted({r[2] for r in rows if weight(r[0])}):
            kept = [(weight(r[0]), r[4]) for r in rows if r[2] >= t]
            n = sum(w for w, _ in kept)
            out.append((n / total, math.sqrt(sum(w * q for w, q in kept) / n)))
        return out

    got = gate.bootstrap_area(df, "coverage", "square", replicates=40, seed=3).first()
    areas = [trapezoids(curve(lambda f, t=t: t.get(f, 0))) for t in times.values()]
    assert got["point"] == pytest.approx(trapezoids(curve(lambda f: 1))) and got["n"] == 40
    assert (got["lo"], got["hi"]) == tuple(pytest.approx(x) for x in np.percentile(areas, [2.5, 97.5]))

    levels = [0.1, 0.4, 0.7, 1.0]
    cells = {(r["level"], r["fold"]): r for r in gate.hybrid_folds(df, 4, levels).collect()}
    assert len(cells) == 20 and all(r["kept"] <= r["n"] == 24 for r in cells.values())

    def hybrid(weight):
        points = {}
        for level in levels:
            n, kept, error = (sum(weight(f) * cells[level, f][c] for f in {r[0] for r in rows}) for c in ("n", "kept", "error"))
            if kept:
                points.setdefault(kept / n, []).append(math.sqrt(error / kept))
        return [(x, sum(y) / len(y)) for x, y in points.items()]

    got = gate.bootstrap_hybrid(df, 4, levels, replicates=40, seed=3).first()
    areas = [trapezoids(hybrid(lambda f, t=t: t.get(f, 0))) for t in times.values()]
    assert got["point"] == pytest.approx(trapezoids(hybrid(lambda f: 1)))
    assert (got["lo"], got["hi"]) == tuple(pytest.approx(x) for x in np.percentile(areas, [2.5, 97.5]))


def test_random_baseline(spark):
    rng = random.Random(13)
    df = spark.createDataFrame([(i, rng.random(), rng.random() * 4) for i in range(200)], "id long, coverage double, square double").cache()
    curve = {r["n_retained"]: r for r in gate.risk_coverage_random(df, "id", "coverage", "square").collect()}
    whole = math.sqrt(df.agg(F.avg("square")).first()[0])
    assert len(curve) == 200 and curve[200]["rmse_random"] == pytest.approx(whole) == pytest.approx(curve[200]["rmse_retained"])
    assert all(abs(r["rmse_random"] - whole) < 0.15 for n, r in curve.items() if n > 20)
