"""Boosted trees with grouped folds, residual bands and a coverage gate, on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.graph import fold_edges, neighbour_statistics
from attestor.operators.stats import quantiles

# Fixed values of the model: rounds, depth, rate, share of rows, seed.
ROUNDS, DEPTH, RATE, SHARE, SEED = 30, 3, 0.1, 0.8, 42


def with_indicators(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``rows`` with nulls and NaN replaced by 0 and an indicator beside each column, since the trees take no gaps."""
    out = rows.withColumns({f"{c}_given": (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).cast("double") for c in columns})
    out = out.withColumns({c: F.when(F.col(f"{c}_given") == 1, F.col(c).cast("double")).otherwise(0.0) for c in columns})
    return out, [*columns, *[f"{c}_given" for c in columns]]


def fit(rows: DataFrame, columns: Sequence[str], target: str, rounds: int = ROUNDS):
    """A model of ``target`` over the columns in just this order."""
    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=DEPTH, stepSize=RATE, subsamplingRate=SHARE, seed=SEED).fit(data)


def predict(model, rows: DataFrame, columns: Sequence[str], out: str = "prediction") -> DataFrame:
    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)
    return model.transform(data).drop("features").withColumnRenamed("prediction", out)


def grouped_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """``rows`` with ``fold``: groups stay whole."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col(group)), F.lit(folds)).cast("int"))


def cross_validated(rows: DataFrame, columns: Sequence[str], target: str, folds: int, rounds: int = ROUNDS) -> DataFrame:
    """Out-of-fold predictions of rows that have a ``fold``; a model is fitted for each fold on the others."""
    out = None
    for k in range(folds):
        part = predict(fit(rows.where(F.col("fold") != k), columns, target, rounds), rows.where(F.col("fold") == k), columns)
        out = part if out is None else out.unionByName(part)
    return out


GRAPH_STEMS = ("nbr_mean", "nbr_std", "mean_weight", "coverage")


def fold_features(edges: dict[str, DataFrame], folds: DataFrame, targets: DataFrame, k: int = 5) -> tuple[DataFrame, list[str]]:
    """(fold, id, is_test, features of each view): with each fold held out in turn, of every row over its k best training neighbours.

    ``edges`` are stored edges by view, ``folds`` (id, fold), ``targets`` (id, y).  A fold's features come from its training rows
    alone, and no row is its own neighbour; without neighbours coverage is 0 and the rest null.
    """
    every = folds.agg(F.array_sort(F.collect_set("fold")).alias("folds"))  # one array of all folds
    out = folds.select("id", F.col("fold").alias("own")).join(F.broadcast(every)).select(F.explode("folds").alias("fold"), "id", "own")
    out = out.withColumn("is_test", F.col("fold") == F.col("own")).drop("own")
    placed, columns = folds.select("id", F.col("fold").alias("grp")), []
    for view, own in edges.items():
        names = [f"{view}_{s}" for s in GRAPH_STEMS]
        known = neighbour_statistics(fold_edges(own, placed, k), targets, ("fold", "src")).select("fold", F.col("src").alias("id"), *[F.col(s).alias(n) for s, n in zip(GRAPH_STEMS, names, strict=True)])
        out = out.join(known, ["fold", "id"], "left").withColumn(f"{view}_coverage", F.coalesce(f"{view}_coverage", F.lit(0.0)))
        columns += names
    return out, columns


def fold_models(rows: DataFrame, columns: Sequence[str], target: str, rounds: int = ROUNDS, at_once: int = 4) -> DataFrame:
    """Out-of-fold predictions of rows (fold, is_test, columns): a model for each fold from its rows that are no test rows.

    Folds are fitted side by side, ``at_once`` of them.
    """
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())

    @inheritable_thread_target(rows.sparkSession)
    def one(k: int) -> DataFrame:
        own = rows.where(F.col("fold") == k)
        return predict(fit(own.where(~F.col("is_test")), columns, target, rounds), own.where("is_test"), columns)

    with ThreadPool(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, folds))


def residual_band(predictions: DataFrame, target: str, coverage: str, buckets: int = 4, lo: float = 0.16, hi: float = 0.84) -> DataFrame:
    """(bucket, from, lo, hi): percentiles of out-of-fold residuals by bucket of coverage."""
    shares = {f"c{i}": i / buckets for i in range(buckets)}
    cuts = [F.lit(x) for x in quantiles(predictions, coverage, shares).select(*shares).first() or ()]
    bucket = F.greatest(F.size(F.filter(F.array(*cuts), lambda c: c <= F.col(coverage))), F.lit(1)) if cuts else F.lit(1)
    placed = predictions.select(bucket.alias("bucket"), F.col(coverage).alias("at"), (F.col(target) - F.col("prediction")).alias("r"))
    ends = quantiles(placed, "r", {"lo": lo, "hi": hi}, "bucket").select("bucket", "lo", "hi")
    return placed.groupBy("bucket").agg(F.min("at").alias("from"), F.count(F.lit(1)).alias("n")).join(ends, "bucket", "left").select("bucket", "from", "lo", "hi", "n")


def gated(predictions: DataFrame, coverage: str, threshold: float, band: DataFrame) -> DataFrame:
    """Predictions with a sorted band and ``abstain`` where coverage is under the threshold; those give no value."""
    arranged = band.agg(F.array_sort(F.collect_list(F.struct("from", "lo", "hi"))).alias("bands"))
    both = predictions.join(F.broadcast(arranged))
    own = F.coalesce(F.element_at(F.filter("bands", lambda b: b["from"] <= F.col(coverage)), -1), F.get("bands", F.lit(0)))
    low, high = F.col("prediction") + own["lo"], F.col("prediction") + own["hi"]
    abstain = F.col(coverage) < threshold
    value = lambda x: F.when(~abstain, x)
    return both.select(*predictions.columns, abstain.alias("abstain"), value(F.least(low, high)).alias("low"), value(F.greatest(low, high)).alias("high"), value(F.col("prediction")).alias("value")).drop("bands")


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a hash of key and seed: the same rows on every run and partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
