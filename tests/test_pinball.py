"""Quantile trees against a plain build, and what they are for."""

import math
import random

import numpy as np
import pytest

from attestor.operators import pinball


def nearest(values, q):
    v = sorted(values)
    return v[max(math.ceil(q * len(v)), 1) - 1]


def plain(rows, alphas, rounds, depth, rate, bins):
    """The same models row by row, for one model key."""
    train = [r for r in rows if r[2]]
    features = len(rows[0][4])
    cuts = []
    for j in range(features):
        known = [r[4][j] for r in train if r[4][j] is not None and not math.isnan(r[4][j])]
        cuts.append(sorted({nearest(known, i / bins) for i in range(1, bins)}))
    code = lambda v, c: 0 if v is None or math.isnan(v) else 1 + sum(x < v for x in c)
    x = np.array([[code(v, cuts[j]) for j, v in enumerate(r[4])] for r in rows])
    y, used = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    out = []
    for q in alphas:
        margin = np.full(len(rows), nearest(y[used], q))
        for _ in range(rounds):
            node = np.ones(len(rows), int)
            for level in range(depth):
                for n in range(1 << level, 2 << level):
                    here = used & (node == n)
                    score = lambda m, below, q=q: (below - q * m) ** 2 / (m + 1)
                    total = score(here.sum(), (here & (y < margin)).sum())
                    best = (0.0, 0, 0)
                    for j in range(features):
                        for c in sorted(set(x[here, j]))[:-1]:
                            left = here & (x[:, j] <= c)
                            right = here & (x[:, j] > c)
                            gain = round(score(left.sum(), (left & (y < margin)).sum()) + score(right.sum(), (right & (y < margin)).sum()) - total, 9)
                            if gain > 0:
                                best = max(best, (gain, -j, -int(c)))
                    if best[0] > 0:
                        node = np.where(node == n, 2 * n + (x[:, -best[1]] > -best[2]), node)
            step = {n: nearest((y - margin)[used & (node == n)], q) for n in set(node[used])}
            margin = margin + rate * np.array([step.get(n, 0.0) for n in node])
        out.append(margin)
    return {r[1]: [m[i] for m in out] for i, r in enumerate(rows) if not r[2]}


def made(seed, n, model):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.random(), rng.choice([None, 0.0, 1.0, float("nan")]), round(rng.random(), 1)]
        rows.append((model, i, rng.random() < 0.8, x[0] * 3 + (x[1] == 1.0) + rng.gauss(0, 0.2 + x[0]), x))
    return rows


SCHEMA = "model int, id long, train boolean, y double, x array<double>"


def test_equals_a_plain_build(spark):
    """Two models with their own training rows, grown together, on 500 rows."""
    a, b = made(1, 300, 0), made(2, 200, 7)
    kw = {"rounds": 3, "depth": 2, "rate": 0.3, "bins": 8}
    got = {(r["model"], r["id"]): r["quantiles"] for r in pinball.fit_predict(spark.createDataFrame(a, SCHEMA).repartition(3), "x", 3, [0.16, 0.84], **kw).collect()}
    want = plain(a, [0.16, 0.84], **kw)
    assert got.keys() == {(0, i) for i in want} and all(got[0, i] == pytest.approx(q, abs=1e-9) for i, q in want.items())
    both = pinball.fit_predict(spark.createDataFrame(a + b, SCHEMA).repartition(5), "x", 3, [0.84], **kw).collect()
    assert len(both) == sum(not r[2] for r in a + b)


def test_quantiles_hold_their_share(spark):
    rows = made(3, 2_000, 0)
    s = {r["id"]: r for r in pinball.spread(spark.createDataFrame(rows, SCHEMA), "x", 3, rounds=15, rate=0.2).collect()}
    held = [(r[3], s[r[1]]) for r in rows if not r[2]]
    inside = sum(q["lo"] <= y <= q["hi"] for y, q in held) / len(held)
    assert 0.55 < inside < 0.8 and all(q["spread"] == max(q["hi"] - q["lo"], 0) for _, q in held)
    wide, narrow = ([q["spread"] for r in rows if not r[2] and test(r[4][0]) for q in [s[r[1]]]] for test in (lambda v: v > 0.8, lambda v: v < 0.2))
    assert np.mean(wide) > 1.5 * np.mean(narrow)


def test_odd_rows(spark):
    """A model without training rows, one value for all, no rows."""
    rows = [(0, 1, False, 1.0, [1.0]), (1, 2, True, 2.0, [None]), (1, 3, True, 2.0, [1.0]), (1, 4, False, 0.0, [5.0])]
    got = {r["id"]: r["quantiles"] for r in pinball.fit_predict(spark.createDataFrame(rows, SCHEMA), "x", 1, [0.5], rounds=2).collect()}
    assert got == {1: None, 4: [2.0]}
    assert pinball.fit_predict(spark.createDataFrame([], SCHEMA), "x", 1, [0.5], rounds=1).count() == 0
