"""Lookups and evaluations that combine other operators: recorded answers, filters that may not apply, taxonomies, bootstraps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx


class Recorded:
    """Results of queries stored by the key of their text and parameters; asking for another one is a KeyError."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def key(self, query: str, params: dict[str, str]) -> str:
        row = self.spark.createDataFrame([(query, params)], "q string, p map<string,string>").select(tx.query_key(F.col("q"), F.col("p")).alias("k")).select(F.sha1("k")).first()
        return row[0]

    def record(self, query: str, params: dict[str, str], result: DataFrame) -> None:
        result.write.mode("overwrite").parquet(f"{self.folder}/{self.key(query, params)}")

    def ask(self, query: str, params: dict[str, str]) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.folder}/{self.key(query, params)}")
        except AnalysisException as e:
            raise KeyError(f"no recorded answer to {query!r} with {params}") from e

    def run(self, query: str, params: dict[str, str], live: Callable[[], DataFrame] | None = None) -> DataFrame:
        """The live answer if there is a source for it, else the recorded one."""
        return live() if live else self.ask(query, params)


def filter_if_any(rows: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Per key the rows that meet a condition, or all of them where none does."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("hit__", F.coalesce(condition, F.lit(False))).withColumn("any__", F.max("hit__").over(w)).where("hit__ or not any__").drop("hit__", "any__")


def wrong_kind(answer: Column, gold: Column, unit: Column, variants: Column) -> Column:
    """Why an answer isn't right: refused, no_value, unit_confused, variant_value (of ``variants``, arrays of values) or fabricated_or_stale."""
    score = tx.score_value(answer, gold, unit)
    variant = F.exists(variants, lambda v: tx.score_value(answer, F.array(v), unit) == "correct")
    return (
        F.when(score == "correct", "correct").when((score == "no_value") & tx.hedges(answer), "refused").when(score == "no_value", "no_value")
        .when(score == "unit_confused", "unit_confused").when(variant, "variant_value").otherwise("fabricated_or_stale")
    )


def bootstrap_rmse(rows: DataFrame, fold: str, square: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(n, lo, median, hi): interval of the RMSE over folds drawn with replacement, each draw a hash of replicate and place.

    Only sums per fold enter, so a replicate costs as much as there are folds.
    """
    sums = rows.groupBy(F.col(fold).alias("fold")).agg(F.sum(square).alias("s"), F.count(F.lit(1)).alias("n"))
    numbered = sums.withColumn("i", F.row_number().over(Window.orderBy("fold")) - 1)
    size = numbered.agg(F.count(F.lit(1)).alias("folds"))
    draws = rows.sparkSession.range(replicates).select(F.col("id").alias("rep")).join(F.broadcast(size)).select("rep", "folds", F.explode(F.sequence(F.lit(0), F.col("folds").cast("int") - 1)).alias("place"))
    drawn = draws.select("rep", F.pmod(F.xxhash64("rep", "place", F.lit(seed)), F.col("folds")).cast("int").alias("i"))
    each = drawn.join(F.broadcast(numbered), "i").groupBy("rep").agg(F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"))
    return each.agg(F.count(F.lit(1)).alias("n"), *[F.percentile("rmse", F.lit(q)).alias(c) for c, q in (("lo", 0.025), ("median", 0.5), ("hi", 0.975))])


def input_limits(bank: DataFrame, columns: list[str]) -> DataFrame:
    """(column, lo, hi) of a bank's features."""
    pairs = bank.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns])
    return pairs.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "v")).select("column", "v.lo", "v.hi")


def refused_inputs(requests: DataFrame, key: str, limits: DataFrame, columns: list[str]) -> DataFrame:
    """(key, column, value) of requested features outside the bank's limits."""
    long = requests.select(F.col(key), F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))).alias("column", "value"))
    return long.join(F.broadcast(limits), "column").where("value is null or value < lo or value > hi").select(key, "column", "value")


def findings(rows: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` repeated for each rule (name to level and condition) that a row breaks, with ``level`` and ``rule``."""
    broken = F.array(*[F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"))) for name, (level, cond) in rules.items()])
    return rows.withColumn("f__", F.explode(F.filter(broken, lambda x: x.isNotNull()))).select(*rows.columns, "f__.level", "f__.rule")
