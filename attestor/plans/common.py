"""Small helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """``df`` with its double columns rounded, since engines add in different orders; ``own`` sets digits by column."""
    return df.withColumns({n: F.round(n, own.get(n, digits)) for n, t in df.dtypes if t == "double"})


def seconds(ts: str):
    """Seconds since 1970 of a time without a zone."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
