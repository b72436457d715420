"""What a served model needs, as versions below one folder: the model, its bank of neighbours, their scaling, and a manifest.

A version's parts are written first; its manifest, which names them, comes last.  Spark marks a folder as complete only once all
of it is written, and the complete manifest with the highest number is the one that is served.  So a reader sees either the
whole old version or the whole new one, whatever happens meanwhile.  Changing the gate alone writes a manifest that names the old parts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import graph, models
from attestor.operators.stats import quantiles
from attestor.storage import stored


@dataclass(frozen=True)
class Manifest:
    """Where the parts of a version are, and what it takes to use them."""

    version: int
    model: str
    bank: str
    columns: list[str]
    k: int
    q: float
    threshold: float
    n_rows: int
    rmse: float


class Artifacts:
    """Versions of one model below ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all complete manifests, ascending."""
        path, files = self._files()
        if not files.exists(path):
            return []
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and files.exists(hadoop(f"{self.folder}/{n}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> Manifest:
        """That of a version, or the newest."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"no complete version {'' if version is None else version} below {self.folder}")
        text = self.spark.read.text(f"{self.folder}/manifest-{version or known[-1]:06d}").first()[0]
        return Manifest(**json.loads(text))

    def _publish(self, m: Manifest) -> Manifest:
        line = self.spark.createDataFrame([(json.dumps(asdict(m), sort_keys=True),)], "value string")
        line.coalesce(1).write.text(f"{self.folder}/manifest-{m.version:06d}")
        return m

    def train(self, rows: DataFrame, columns: Sequence[str], q: float, k: int = 5, rounds: int = models.ROUNDS) -> Manifest:
        """Fit on rows (id, grp, y, columns), keep them as the bank, and publish a new version.

        Neighbours come from other groups only, as they do when a known row is served; the gate's threshold is the q-th
        percentile of the bank's own coverage.
        """
        version = (self.versions() or [0])[-1] + 1
        parts = f"{self.folder}/parts-{version:06d}"
        bank = rows.select("id", "grp", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in columns])
        bank.write.mode("overwrite").parquet(f"{parts}/bank")  # parts without a manifest are those of a run that failed
        bank = self.spark.read.schema(bank.schema).parquet(f"{parts}/bank")
        data, names = self._designed(stored(graph.query_features(bank, bank, columns, k, exclude_group=True), "features"), bank, columns)
        model = models.fit(data, names, "y", rounds)
        model.write().overwrite().save(f"{parts}/model")
        threshold = quantiles(data, "coverage", {"t": q / 100}).first()["t"]
        fit = models.predict(model, data, names).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2.0)))).alias("rmse")).first()
        return self._publish(Manifest(version, f"{parts}/model", f"{parts}/bank", list(columns), k, q, threshold, fit["n"], fit["rmse"]))

    @staticmethod
    def _designed(features: DataFrame, rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
        """The columns of the model in their order, with indicators for gaps; ``coverage`` stays as it is."""
        return models.with_indicators(features.join(rows, "id"), [*columns, "nbr_mean", "nbr_std", "mean_weight", "coverage"])

    def serve(self, requests: DataFrame, version: int | None = None) -> DataFrame:
        """(id, prediction, coverage, abstain, value) of requests (id, grp, columns) by a version's parts alone.

        The value is null where the gate abstains.  A request that is in the bank is judged by the others of other groups.
        """
        m = self.manifest(version)
        bank = self.spark.read.parquet(m.bank)
        picked = stored(requests.select("id", "grp", *[F.col(c).cast("double").alias(c) for c in m.columns]), "requests")
        features = graph.query_features(picked, bank, m.columns, m.k, exclude_group=True)
        data, names = self._designed(features, picked, m.columns)
        out = models.predict(GBTRegressionModel.load(m.model), data, names)
        abstain = F.col("coverage") < m.threshold
        return out.select("id", "prediction", "coverage", abstain.alias("abstain"), F.when(~abstain, F.col("prediction")).alias("value"))

    def rewrite_gate(self, q: float) -> Manifest:
        """A new version with another percentile; model, bank and all else are those of the newest one, byte for byte."""
        m = self.manifest()
        bank = self.spark.read.parquet(m.bank)
        c = graph.query_features(bank, bank, m.columns, m.k, exclude_group=True).select("coverage")
        threshold = quantiles(c, "coverage", {"t": q / 100}).first()["t"]
        return self._publish(Manifest(**{**asdict(m), "version": m.version + 1, "q": q, "threshold": threshold}))


def disagreements(a: DataFrame, b: DataFrame, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(id, column, a, b) wherever two results by id differ by more than ``tolerance``, or only one of them has a value."""
    long = lambda rows, name: rows.select("id", F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))).alias("column", name))
    both = long(a, "a").join(long(b, "b"), ["id", "column"], "full")
    same = F.col("a").eqNullSafe(F.col("b")) | (F.abs(F.col("a") - F.col("b")) <= tolerance)
    return both.where(~F.coalesce(same, F.lit(False)))
