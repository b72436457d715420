"""Joins on keys of which a few may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one of so many rows is hot; there are fewer of them than that.
SHARE = 1000
#: Parts that a hot key's rows are dealt to.
SALTS = 128


def salted_join(rows: DataFrame, table: DataFrame, key: str, weight: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and, as ``weight``, the number of its rows in ``rows``.

    Rows of hot keys are dealt by a hash of ``by``, and only these keys' rows of ``table`` are repeated for each part.  The hot keys
    themselves, fewer than ``SHARE``, are broadcast.  ``table`` is read three times, so it should be stored.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.broadcast(table.where(F.col(weight) * SHARE > total).select(key, F.lit(True).alias("hot__")))
    salt = lambda some: F.when(F.col("hot__"), some)
    dealt = rows.join(hot, key, "left").withColumn("salt__", salt(F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot__")
    parts = salt(F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = table.join(hot, key, "left").withColumn("salt__", F.explode(parts)).drop("hot__")
    return dealt.join(repeated, [key, "salt__"], how).drop("salt__")
