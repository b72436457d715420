"""Versions of a served model: batch and served results agree, versions switch as a whole, gates change alone."""

import pathlib
import random

import pytest
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from attestor.operators import artifacts, graph, models

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(16)
    made = [(i, i % 6, a * 2 + b, a, None if i % 11 == 0 else b) for i in range(150) for a, b in [(rng.random(), rng.random())]]
    return spark.createDataFrame(made, "id long, grp long, y double, a double, b double").cache()


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in pathlib.Path(folder).rglob("*") if p.is_file() and p.suffix != ".crc"}


def test_batch_and_served_agree(spark, rows, tmp_path):
    shelf = artifacts.Artifacts(spark, f"file://{tmp_path}/m")
    with pytest.raises(FileNotFoundError):
        shelf.manifest()
    m = shelf.train(rows, COLUMNS, 41.0, k=4, rounds=5)
    assert (m.version, m.n_rows, shelf.versions()) == (1, 150, [1])
    features = graph.query_features(rows, rows, COLUMNS, 4, exclude_group=True)
    data, names = models.with_indicators(features.join(rows, "id"), [*COLUMNS, "nbr_mean", "nbr_std", "mean_weight", "coverage"])
    batch = models.predict(GBTRegressionModel.load(m.model), data, names)
    served = shelf.serve(rows)
    assert served.count() == 150
    assert artifacts.disagreements(batch, served, ["prediction", "coverage"]).count() == 0
    error = served.join(rows, "id").agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2.0))))).first()[0]
    assert error == pytest.approx(m.rmse, abs=1e-9)  # what training saw
    again = artifacts.Artifacts(spark, f"file://{tmp_path}/m").serve(rows.repartition(5))
    assert artifacts.disagreements(served, again, ["prediction", "coverage", "value"]).count() == 0
    share = served.where("abstain").count() / 150
    assert 0.3 < share < 0.5 and served.where("abstain and value is not null").count() == 0
    one = shelf.serve(rows.where("id = 7")).first()  # the same alone as among others
    assert one["prediction"] == pytest.approx(served.where("id = 7").first()["prediction"], abs=1e-9)


def test_versions_and_gates(spark, rows, tmp_path):
    shelf = artifacts.Artifacts(spark, f"file://{tmp_path}/m")
    shelf.train(rows, COLUMNS, 41.0, k=3, rounds=2)
    before = tree(tmp_path)
    m = shelf.rewrite_gate(90.0)
    after = tree(tmp_path)
    assert all(after[k] == v for k, v in before.items()) and {k.split("/")[1] for k in after.keys() - before.keys()} == {"manifest-000002"}
    assert (m.version, m.q) == (2, 90.0) and m.threshold > shelf.manifest(1).threshold and m.model == shelf.manifest(1).model
    assert shelf.serve(rows).where("abstain").count() > shelf.serve(rows, 1).where("abstain").count()
    (pathlib.Path(tmp_path) / "m/manifest-000003").mkdir()  # one that was never finished
    assert shelf.versions() == [1, 2] and shelf.manifest().version == 2
    with pytest.raises(FileNotFoundError):
        shelf.manifest(9)
