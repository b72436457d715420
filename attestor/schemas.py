"""Contracts of the tables: names, order, types and which columns must be given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row for each cell and cycle; the first four are never null.
CYCLES = T.StructType(
    [
        T.StructField("cell_id", T.StringType(), False), T.StructField("study", T.StringType(), False), T.StructField("cycle_index", T.LongType(), False),
        T.StructField("discharge_capacity_ah", T.DoubleType(), False), T.StructField("chemistry", T.StringType()), T.StructField("nominal_capacity_ah", T.DoubleType()),
        T.StructField("temperature_c", T.DoubleType()), T.StructField("dod_window", T.StringType()), T.StructField("c_rate_charge", T.StringType()),
        T.StructField("c_rate_discharge", T.StringType()),
    ]
)
CLAIM = "struct<property:string,value:array<double>,unit:string,page:int,conditions:map<string,string>>"


class ContractError(ValueError):
    """A table misses what its contract demands."""


def conform(rows: DataFrame, contract: T.StructType = CYCLES, sort: tuple[str, ...] = ("cell_id", "cycle_index")) -> DataFrame:
    """``rows`` in contract order and types, sorted within partitions.

    A missing required column is an error at once, a missing other one becomes null, further columns go.  Null in a
    required column fails when the rows are read, in the same pass.
    """
    required = [f.name for f in contract if not f.nullable]
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    out = []
    for f in contract:
        col = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            col = F.when(~F.isnan(col), col)
        if not f.nullable:
            col = F.coalesce(col, F.raise_error(F.lit(f"null in required column {f.name}")).cast(f.dataType))
        out.append(col.alias(f.name))
    return rows.select(*out).sortWithinPartitions(*sort)


def missing_counts(rows: DataFrame, contract: T.StructType = CYCLES) -> DataFrame:
    """(column, nulls) of the required columns, one pass."""
    required = [f.name for f in contract if not f.nullable]
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, required)), F.array(*required))).alias("column", "nulls"))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once: empty where the key is unique."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
