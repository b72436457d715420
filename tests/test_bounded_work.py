"""Work that does not grow faster than the tables: candidates of neighbours by one comparison, pairs in partitions of bounded size."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from attestor.operators import graph, matching, stats
from attestor.plans import store_queries


def test_candidates_within_bounds_hold_all_nearest():
    """Known and unknown bounds, with a query's own row and group left out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    rows = pd.DataFrame({"id_": range(300), "grp_": [n % 4 for n in range(300)], "vec_": list(x)})
    away = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for group in (False, True):
        far = np.where(np.eye(300, dtype=bool) | (group & (rows["grp_"].to_numpy()[:, None] == rows["grp_"].to_numpy()[None])), np.inf, away)
        bound = np.where(np.arange(300) % 3 == 0, np.inf, np.sort(far, axis=1)[:, 4] * 1.2)
        got = {}
        for part, i, j in graph._candidates(rows.assign(bound=bound), rows, x, 5, True, group):
            for a, b in zip(part["id_"].to_numpy()[i], j, strict=True):
                got.setdefault(a, set()).add(b)
        for n in range(300):
            assert set(np.argsort(far[n])[:5]) <= got[n] and all(np.isfinite(far[n, m]) for m in got[n])
            assert n % 3 == 0 or all(far[n, m] <= bound[n] * (1 + 1e-6) for m in got[n])


def test_pairs_of_claims_are_dealt_by_the_size_of_the_table(spark, monkeypatch, tmp_path):
    """Twenty rows, at most two in a partition on average; parts of one supplier have no pair."""
    rows = "id % 7 as l_partkey, id % 3 as l_suppkey, cast(id as double) as l_quantity, 0.1d as l_discount, cast(1 as int) as l_linenumber"
    spark.range(20).selectExpr(*rows.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(store_queries, "DEALT", 2, raising=False)
    pairs = store_queries._pairs(spark, str(tmp_path))
    assert pairs.rdd.getNumPartitions() == 10
    assert sorted(r["l_partkey"] for r in pairs.collect()) == list(range(7))


def test_quantiles_of_long_groups_order_only_values_near_them(spark, monkeypatch):
    """A long group with a value that half its rows share, a short one and one without values; no window takes a long group whole."""
    rng = np.random.default_rng(8)
    own = {"long": np.where(rng.random(6000) < 0.5, 0.25, rng.normal(size=6000)), "short": rng.normal(size=9)}
    rows = [(g, float(x)) for g, xs in own.items() for x in xs] + [("long", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    monkeypatch.setattr(stats, "ONE_TASK", 1000)
    asked, taken = [], stats._short_ends
    monkeypatch.setattr(stats, "_short_ends", lambda known, *rest: (asked.append(known.count()), taken(known, *rest))[1])
    got = {r["g"]: r for r in stats.distribution(df, "v", "g").collect()}
    assert asked == [9]
    for g, xs in own.items():
        assert got[g]["n"] == len(xs)
        assert np.allclose([got[g][c] for c in ("least", "q1", "median", "q3", "most")], np.percentile(xs, [0, 25, 50, 75, 100]), rtol=0, atol=1e-12)
    assert got["none"]["n"] == 0 and got["none"]["median"] is None
    whole = stats.quantiles(df, "v", {"lo": 0.005, "hi": 0.995}).first()
    assert whole["n"] == 6009 and np.allclose([whole["lo"], whole["hi"]], np.percentile(np.concatenate(list(own.values())), [0.5, 99.5]), rtol=0, atol=1e-12)


def test_quantiles_beyond_the_bounds_of_a_sketch_are_searched_again(spark, monkeypatch):
    """A sketch that is off gives wider bounds, not wrong values."""
    xs = np.random.default_rng(9).permutation(5000).astype(float)
    monkeypatch.setattr(stats, "ONE_TASK", 1000)
    right = F.percentile_approx
    monkeypatch.setattr(stats.F, "percentile_approx", lambda v, at, accuracy: right(v + 20.0, at, accuracy))
    got = stats.quantiles(spark.createDataFrame([(float(x),) for x in xs], "v double"), "v", {"a": 0.3, "b": 0.9}).first()
    assert np.allclose([got["a"], got["b"]], np.percentile(xs, [30, 90]), rtol=0, atol=1e-9)


def test_values_of_long_groups_are_read_three_times(spark, monkeypatch):
    """Once for sizes, once for sketches and once for all counts; the result reads none of them."""
    rng = np.random.default_rng(12)
    own = {g: rng.normal(size=3000) for g in "ab"}
    df = spark.createDataFrame([(g, float(x)) for g, xs in own.items() for x in xs], "g string, v double")
    monkeypatch.setattr(stats, "ONE_TASK", 1000)
    reads, keep = [], stats.stored
    values = lambda d: sum("/measured-" in f for f in d.inputFiles())
    monkeypatch.setattr(stats, "stored", lambda d, name: (reads.extend([name] * (values(d) > 0)), keep(d, name))[1])
    got = stats.distribution(df, "v", "g")
    assert reads == ["sizes", "bounds", "counts"] and values(got) == 0
    for r in got.collect():
        assert np.allclose([r[c] for c in ("least", "q1", "median", "q3", "most")], np.percentile(own[r["g"]], [0, 25, 50, 75, 100]), rtol=0, atol=1e-12)


def test_quantiles_without_any_bound(spark, monkeypatch):
    """A sketch that is far off leaves all values to be counted, with a group or none."""
    xs = np.random.default_rng(13).permutation(3000).astype(float)
    monkeypatch.setattr(stats, "ONE_TASK", 1000)
    right = F.percentile_approx
    monkeypatch.setattr(stats.F, "percentile_approx", lambda v, at, accuracy: right(v + 2000.0, at, accuracy))
    df = spark.createDataFrame([("a", float(x)) for x in xs], "g string, v double")
    for group in (None, "g"):
        got = stats.quantiles(df, "v", {"b": 0.9, "a": 0.3}, group).first()
        assert got["n"] == 3000 and np.allclose([got["a"], got["b"]], np.percentile(xs, [30, 90]), rtol=0, atol=1e-9)


def test_rows_without_a_group_are_one(spark, monkeypatch):
    """As GROUP BY has it, in short and long groups."""
    xs = np.random.default_rng(14).normal(size=2001)
    df = spark.createDataFrame([(g, float(x)) for g in ("a", None) for x in xs] + [("b", None)], "g string, v double")
    for most in (10_000, 1000):
        monkeypatch.setattr(stats, "ONE_TASK", most)
        got = {r["g"]: r for r in stats.distribution(df, "v", "g").collect()}
        assert {g: r["n"] for g, r in got.items()} == {"a": 2001, None: 2001, "b": 0} and got["b"]["least"] is None
        for g in ("a", None):
            assert np.allclose([got[g][c] for c in ("least", "q1", "median", "q3", "most")], np.percentile(xs, [0, 25, 50, 75, 100]), rtol=0, atol=1e-12)


def test_both_views_are_matched_in_one_pass(spark):
    """The rule by itself, first within part and flag, then by part over what is left; rows without a value or words too."""
    rng = np.random.default_rng(11)
    sides = []
    for first in (0, 1000):
        value = [None if n % 29 == 0 else float(v) for n, v in enumerate(rng.integers(1, 12, 200))]
        words = [None if n % 31 == 0 else [str(w) for w in rng.integers(0, 4, 3)] for n in range(200)]
        sides.append([(first + n, int(k), None if f == 0 else str(f), v, w) for n, (k, f, v, w) in enumerate(zip(rng.integers(0, 9, 200), rng.integers(0, 3, 200), value, words, strict=True))])
    expected, gone = [], set()
    for width, view in ((2, "exact"), (1, "naming_only")):
        for r in sides[0]:
            own = set(r[4] or ())
            alike = [
                (len(own & set(s[4] or ())) / max(1, len(own | set(s[4] or ()))), -s[0]) for s in sides[1]
                if s[0] not in gone and r[0] not in gone and s[1 : 1 + width] == r[1 : 1 + width] and None not in (r[3], s[3]) and matching.near(r[3], s[3])
            ]
            if alike:
                expected.append((r[0], -max(alike)[1], view))
                gone |= {r[0], -max(alike)[1]}
    ref, sec = (spark.createDataFrame(s, "pos long, part int, flag string, value double, words array<string>") for s in sides)
    got = matching.match_views(ref, sec, ["part", "flag"], ["part"])
    assert sorted(map(tuple, got.collect())) == sorted(expected) and {v for _, _, v in expected} == {"exact", "naming_only"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
