"""Entity and edge tables: ids, upserts, rebuilt parts, counts and paths.

A table of entities is a Parquet folder with one row for each key; a write goes to a new version beside the old one, and
loading the same rows again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ordinal_ids(rows: DataFrame, parts: Sequence[str], order: Sequence[Column | str], out: str = "id") -> DataFrame:
    """``rows`` with an id of its parts and the row's number among equal parts, from 0."""
    nth = F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1
    return rows.withColumn(out, F.concat_ws(":", *[F.col(p).cast("string") for p in parts], nth.cast("string")))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: Sequence[str] = (), overwrite: Sequence[str] = ()) -> DataFrame:
    """``old`` with ``new`` merged in by key.

    A new value replaces the old one unless it is null; columns in ``keep_old`` change only where the old value is null,
    those in ``overwrite`` also become null.
    """
    o, n = old.alias("o"), new.alias("n")

    def merged(c: str) -> Column:
        before, after = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep_old:
            return F.coalesce(before, after).alias(c)
        if c in overwrite:
            return F.when(F.col(f"n.{key}").isNotNull(), after).otherwise(before).alias(c)
        return F.coalesce(after, before).alias(c)

    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c == key else merged(c) for c in old.columns])


def replace_part(edges: DataFrame, new: DataFrame, sources: DataFrame, view: str) -> DataFrame:
    """``edges`` with those of one view for the given sources replaced; a null view counts as ``condition``."""
    own = F.coalesce("view", F.lit("condition")) == view
    rest = edges.where(~own).unionByName(edges.where(own).join(sources.select("src").distinct(), "src", "left_anti").select(edges.columns))
    return rest.unionByName(new.select(edges.columns))


def measurement_rows(instances: DataFrame, instance: str, metrics: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """(id, instance, metric, value, censored, unit): one row per metric; a value that wasn't reached is null and censored.

    ``metrics`` maps a name to its value, whether it was reached, and its unit.
    """
    each = [
        F.struct(F.lit(m).alias("metric"), F.when(reached, value).alias("value"), (~reached).alias("censored"), F.lit(unit).alias("unit"))
        for m, (value, reached, unit) in metrics.items()
    ]
    rows = instances.select(F.col(instance).alias("instance"), F.inline(F.array(*each)))
    return rows.select(F.concat_ws(":", F.col("instance").cast("string"), "metric").alias("id"), "instance", "metric", "value", "censored", "unit")


def save_version(rows: DataFrame, folder: str, version: int) -> DataFrame:
    """Write a version of a table and read it; an existing one is replaced, so a repeated load is harmless."""
    at = f"{folder}/v{version:06d}"
    rows.write.mode("overwrite").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def counts_by(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(label, n): rows of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "label string, n long")
