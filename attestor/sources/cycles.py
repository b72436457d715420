"""Readers of cycling data in files: named CSV files, raw charge and discharge steps, screens and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Study_chemistry_temperature_window_rates_cell: the fields that a file name encodes.
FILE_NAME = r"^([A-Za-z]+)_([A-Z]+)_(\d+)C_(\d+-\d+)_([\d.]+)-([\d.]+)C_([a-z])"


def landing(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(name, length, state) of files against (name, size): ready, partial, oversized or missing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    both = expected.join(files, "name", "left")
    state = F.when(F.col("length").isNull(), "missing").when(F.col("length") == F.col("size"), "ready").when(F.col("length") > F.col("size"), "oversized").otherwise("partial")
    return both.select("name", "length", state.alias("state"))


def named_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV rows with the fields of their file's name; files with other names give none."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    part = lambda k: F.regexp_extract("file", FILE_NAME, k)
    rows = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path).withColumn("file", name).where(F.col("file").rlike(FILE_NAME))
    return rows.withColumns({"study": part(1), "chemistry": part(2), "temperature_c": part(3).cast("double"), "window": part(4), "rate_charge": part(5).cast("double"), "rate_discharge": part(6).cast("double"), "cell": part(7)})


def longest_file(rows: DataFrame, series: str, file: str) -> DataFrame:
    """Rows of the longest file of every series, the first by name on a tie."""
    sizes = rows.groupBy(series, file).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(series).orderBy(F.desc("n"), file)
    return rows.join(sizes.withColumn("r", F.row_number().over(w)).where("r = 1").select(series, file), [series, file], "left_semi")


def reference_tests(rows: DataFrame, low: str, high: str, current: str, v_low: float, v_high: float, rate: float) -> DataFrame:
    """Rows of full slow cycles: both ends of the voltage reached and the current under a limit."""
    return rows.where((F.col(low) <= v_low) & (F.col(high) >= v_high) & (F.abs(current) <= rate))


def screened(rows: DataFrame, value: str, nominal: float, file: str) -> tuple[DataFrame, DataFrame]:
    """Rows of at most 110 % of the nameplate value, and (file, n, dropped) as the audit."""
    over = F.col(value) > 1.1 * nominal
    audit = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("dropped"))
    return rows.where(~over), audit


def step_summary(steps: DataFrame, cell: str, cycle: str, order: str, status: str, capacity: str, time: str) -> DataFrame:
    """(cell, cycle, discharged_ah, charge_min) from raw steps.

    Discharge rows say so in their status, charge rows say charge but not discharge; under two rows give null.
    """
    s = F.lower(status)
    out, in_ = s.contains("discharge"), s.contains("charge") & ~s.contains("discharge")
    # min_by and max_by leave out rows whose ordering is null
    first = lambda v, where: F.min_by(v, F.when(where, F.col(order)))
    last = lambda v, where: F.max_by(v, F.when(where, F.col(order)))
    return steps.groupBy(cell, cycle).agg(
        F.when(F.count_if(out) >= 2, (first(capacity, out) - last(capacity, out)) / 1000).alias("discharged_ah"),
        F.when(F.count_if(in_) >= 2, (last(time, in_) - first(time, in_)) / 60).alias("charge_min"),
    )


def decoded(codes: str):
    """Text of an array of character codes, zeros left out."""
    return F.array_join(F.transform(F.filter(codes, lambda c: c != 0), lambda c: F.char(c)), "")


def truncated(*arrays: str) -> list:
    """The arrays cut to the shortest one's length."""
    shortest = F.array_min(F.array(*[F.size(a) for a in arrays]))
    return [F.slice(a, F.lit(1), shortest).alias(a) for a in arrays]


def finite_series(rows: DataFrame, cell: str, cycle: str, value: str, order: str) -> DataFrame:
    """Rows with a finite positive value, the first of each (cell, whole cycle) in order of ``order``."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > 0) & (F.col(value) < float("inf"))).withColumn(cycle, F.round(cycle).cast("long"))
    w = Window.partitionBy(cell, cycle).orderBy(order)
    return good.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__")
