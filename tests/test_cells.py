"""Cells processed from raw steps against a plain version, one cell at a time."""

import math
import random

import numpy as np
import pytest

from attestor.operators import cells

SCHEMA = "cell long, cycle int, seq int, status string, capacity double, voltage double, time double"
EARLY, LATE, LO, LAST = 2, 5, 1, 6


def made():
    rng, rows = random.Random(17), []
    for cell in range(6):
        for cycle in range(1, 9):
            n = rng.choice([1, 8, 14, 30]) if cell % 2 else 14
            rest = rng.randrange(n)
            for seq in range(n):
                status = "rest" if seq == rest and cell == 2 else "CC_Discharge"
                rows.append((cell, cycle, seq, status, 1500.0 - 10 * cycle - seq * (1200 / n) - rng.random(), 4.2 - 0.05 * seq - rng.random() / 50, float(seq)))
            for seq in range(n, n + rng.choice([0, 1, 4])):
                rows.append((cell, cycle, seq, "CV charge", 0.0, 4.2, 60.0 * seq))
    return rows


def by_cycle(rows, cell):
    out = {}
    for r in sorted(rows):
        if r[0] == cell:
            out.setdefault(r[1], []).append(r)
    return out


def tidy(rows, cell, skip):
    out = {}
    for cycle, steps in sorted(by_cycle(rows, cell).items())[skip:]:
        dis = [s[4] for s in steps if "discharge" in s[3].lower()]
        ch = [s[6] for s in steps if "charge" in s[3].lower() and "discharge" not in s[3].lower()]
        if len(dis) >= 2 and dis[0] > dis[-1]:
            out[cycle] = ((dis[0] - dis[-1]) / 1000, (ch[-1] - ch[0]) / 60 if len(ch) >= 2 else None)
    return out


def scalars(a, b, grid):
    v0, q0, v1, q1 = (np.array(x) for c in (a, b) for x in zip(*sorted((s[5], (c[0][4] - s[4]) / 1000) for s in c), strict=True))
    at = np.linspace(max(v0.min(), v1.min()) + 0.01, min(v0.max(), v1.max()) - 0.01, grid)
    d = np.interp(at, v1, q1) - np.interp(at, v0, q0)
    return math.log10(max(d.var(), 1e-12)), math.log10(max(abs(d.min()), 1e-12))


def test_cells_equal_a_plain_version(spark):
    rows = made()
    skipped = spark.createDataFrame([(0, 1), (3, 2)], "cell long, n int")
    got, feats = cells.processed(spark.createDataFrame(rows, SCHEMA), EARLY, LATE, LO, LAST, skipped, grid=50)
    got = {(r["cell"], r["cycle"]): (r["discharge_capacity_ah"], r["charge_min"]) for r in got.collect()}
    feats, n = {r["cell"]: r for r in feats.collect()}, 0
    for cell in range(6):
        want = tidy(rows, cell, {0: 1, 3: 2}.get(cell, 0))
        assert {c: v for (k, c), v in got.items() if k == cell} == {c: (pytest.approx(v[0]), None if v[1] is None else pytest.approx(v[1])) for c, v in want.items()}
        dis = {c: [s for s in steps if "discharge" in s[3].lower()] for c, steps in by_cycle(rows, cell).items() if c in want}
        if not all(len(dis.get(c, [])) >= 10 for c in (EARLY, LATE)):
            assert cell not in feats
            continue
        n += 1
        r, cycles = feats[cell], sorted(want)
        at = lambda k, cycles=cycles, want=want: want[min(cycles, key=lambda c: (abs(c - k), c))][0]
        inside = [c for c in cycles if LO <= c <= LAST]
        assert (r["capacity_early"], r["capacity_late"], r["cap_ratio"]) == tuple(pytest.approx(x) for x in (at(LO), at(LATE), at(LATE) / at(LO)))
        assert r["slope"] == pytest.approx(np.polyfit(inside, [want[c][0] for c in inside], 1)[0])
        times = [want[c][1] for c in cycles if c <= LAST and want[c][1] is not None]
        assert r["mean_charge_min"] == (pytest.approx(np.mean(times)) if times else None)
        assert (r["var_dq"], r["min_dq"]) == tuple(pytest.approx(x, abs=1e-6) for x in scalars(dis[EARLY], dis[LATE], 50))
    assert n >= 3
    with pytest.raises(ValueError, match="boundary"):
        cells.processed(spark.createDataFrame(rows, SCHEMA), 2, 7, 1, 6)


def test_surrogates(spark):
    rows = made()
    steps = spark.createDataFrame(rows, SCHEMA)
    got = {r["cell"]: r for r in cells.surrogate_features(steps, cells.tidy_cycles(steps), 10, 3, grid=50).collect()}
    for cell in range(6):
        own = by_cycle(rows, cell)
        dense = [c for c, s in sorted(own.items()) if sum("discharge" in x[3].lower() for x in s) > 10]
        if len(dense) < 2:
            assert cell not in got
            continue
        second = next((c for c in dense if c - dense[0] >= 3), dense[-1])
        r, want = got[cell], tidy(rows, cell, 0)
        assert (r["first"], r["second"]) == (dense[0], second)

        def longest(c, own=own):
            best, run = [], []
            for s in own[c]:
                run = [*run, s] if "discharge" in s[3].lower() else []
                best = run if len(run) > len(best) else best
            return best

        assert (r["var_dq"], r["min_dq"]) == tuple(pytest.approx(x, abs=1e-6) for x in scalars(longest(dense[0]), longest(second), 50))
        assert r["capacity_early"] == pytest.approx(want[min(want)][0]) and r["capacity_late"] == pytest.approx(want[min(want, key=lambda c: (abs(c - second), c))][0])
        span = [c for c in want if dense[0] <= c <= second]
        assert r["slope"] == (pytest.approx(np.polyfit(span, [want[c][0] for c in span], 1)[0]) if len(span) > 2 else None)


def test_instances_and_evidence(spark):
    lives = spark.createDataFrame([(1, 50.0, 1.05, 60, False), (2, None, 1.2, 70, False), (3, 9.0, 0.2, 9, True), (4, 5.0, 1.0, 9, None)], "cell long, life double, init double, last_cycle long, anomalous boolean")
    early = spark.createDataFrame([(1, 0.5), (3, 0.1)], "cell long, slope double")
    described = spark.createDataFrame([(1, "b"), (2, "a"), (4, None)], "cell long, policy string")
    rows = cells.instances(lives, early, described, "s")
    got = {r["cell"]: r for r in rows.collect()}
    assert got.keys() == {1, 2, 4} and (got[1]["instance_id"], got[1]["policy_group"], got[1]["cycles"], got[1]["censored"], got[1]["slope"]) == ("s_1", "pg001", 50.0, False, 0.5)
    assert (got[2]["policy_group"], got[2]["cycles"], got[2]["censored"]) == ("pg000", 70.0, True) and got[4]["policy_group"] is None
    e = cells.evidence(rows, lives, 1.1).first()
    assert (e["cells_matched"], e["near_nominal"], e["below_nominal"], e["groups"], e["censored"], e["rows_ingested"], e["identity_basis"]) == (3, 3, 2, 2, 1, 4, "signature_consistent")
    assert cells.evidence(rows, lives, 1.1, 0.05).first()["identity_basis"] == "asserted_from_publication"
