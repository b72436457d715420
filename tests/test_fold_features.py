"""Neighbour features by fold: nothing of a held-out row reaches the features of its fold."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import graph, models


def test_held_out_targets_change_nothing(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(i, i % 4, rng.random(), rng.random()) for i in range(80)], "id long, fold int, a double, b double")
    vectors = graph.features(rows, "id", "fold", {c: F.col(c) for c in ("a", "b")})
    edges = {"v": graph.similarity_edges(vectors, "v", 6).cache()}
    folds = rows.select("id", "fold")
    first = rows.select("id", (F.col("a") * 3).alias("y"))
    changed = rows.select("id", F.when(F.col("fold") == 2, 1e6).otherwise(F.col("a") * 3).alias("y"))
    one, two = ({(r["fold"], r["id"]): tuple(r) for r in models.fold_features(edges, folds, y, 3)[0].collect()} for y in (first, changed))
    held = [k for k in one if k[0] == 2]
    assert len(one) == 80 * 4 and len(held) == 80
    for k in held:  # but for the order of adding up
        assert one[k] == pytest.approx(two[k], abs=1e-9), k
    assert max(abs((one[k][3] or 0) - (two[k][3] or 0)) for k in one if k[0] != 2) > 1e3


def test_features_come_from_training_neighbours(spark):
    """Against a plain search of each row's stored edges."""
    rng = random.Random(10)
    rows = spark.createDataFrame([(i, i % 3 if i else 9, rng.random()) for i in range(40)], "id long, fold int, a double")
    edges = graph.similarity_edges(graph.features(rows, "id", "fold", {"a": F.col("a")}), "v", 5).cache()
    stored = {}
    for e in edges.collect():
        stored.setdefault(e["src"], []).append((-e["weight"], e["dst"]))
    fold, y = ({r["id"]: r[c] for r in rows.collect()} for c in ("fold", "a"))
    out, columns = models.fold_features({"v": edges}, rows.select("id", "fold"), rows.select("id", F.col("a").alias("y")), 2)
    assert columns == ["v_nbr_mean", "v_nbr_std", "v_mean_weight", "v_coverage"]
    for r in out.collect():
        near = [(-w, d) for w, d in sorted(stored[r["id"]]) if fold[d] != r["fold"]][:2]
        assert r["is_test"] == (fold[r["id"]] == r["fold"])
        if near:
            mean = sum(w * y[d] for w, d in near) / sum(w for w, _ in near)
            assert abs(r["v_nbr_mean"] - mean) < 1e-9 and abs(r["v_coverage"] - sum(w for w, _ in near)) < 1e-9
        else:
            assert r["v_nbr_mean"] is None and r["v_coverage"] == 0
