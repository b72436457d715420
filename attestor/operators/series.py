"""Per-entity kernels over ordered measurements: life, flags, runs, interpolation.

An entity (a cell) has rows (entity, cycle, value).  All kernels are window or group plans with the entity as key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.values import finite

# End of life at 80 %, accepted 1 % above it at the end of a series.
END_SHARE, END_TOLERANCE = 0.8, 0.01
SHORT_SERIES = 50
ANOMALIES = ("non_finite_capacity", "capacity_gt_nominal", "low_initial_capacity", "capacity_spike_down")


def smoothed(rows: DataFrame, entity: str, cycle: str, value: str, reach: int = 2) -> DataFrame:
    """``rows`` with ``smooth``: the centred rolling median over 2 * reach + 1 rows, fewer at the ends."""
    w = Window.partitionBy(entity).orderBy(cycle).rowsBetween(-reach, reach)
    return rows.withColumn("smooth", F.percentile(value, F.lit(0.5)).over(w))


def first_values(rows: DataFrame, entity: str, cycle: str, value: str, n: int = 5) -> DataFrame:
    """(entity, init): the median of the first n raw values."""
    w = Window.partitionBy(entity).orderBy(cycle)
    ranked = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    return ranked.groupBy(entity).agg(F.percentile(value, F.lit(0.5)).alias("init"))


def crossing(rows: DataFrame, entity: str, cycle: str, value: str, threshold: str, nearest: bool = False) -> DataFrame:
    """(entity, crossing): where ``value`` first is at or under ``threshold``, between the two cycles around it.

    The first cycle counts if the series starts there; a flat bracket gives the later cycle.  With ``nearest`` the closer
    of the two cycles is taken instead of a point between them.  Entities that never cross have no row.
    """
    w = Window.partitionBy(entity).orderBy(cycle)
    step = rows.select(entity, F.col(cycle).cast("double").alias("n1"), F.col(value).alias("c1"), F.col(threshold).alias("thr"), F.lag(F.col(cycle).cast("double")).over(w).alias("n0"), F.lag(value).over(w).alias("c0"))
    share = (F.col("c0") - F.col("thr")) / (F.col("c0") - F.col("c1"))
    between = F.col("n0") + share * (F.col("n1") - F.col("n0"))
    if nearest:
        between = F.when(F.abs(F.col("c0") - F.col("thr")) <= F.abs(F.col("c1") - F.col("thr")), F.col("n0")).otherwise(F.col("n1"))
    at = F.when(F.col("n0").isNull() | (F.col("c0") == F.col("c1")), F.col("n1")).otherwise(between)
    return step.where(F.col("c1") <= F.col("thr")).groupBy(entity).agg(F.min_by(at, "n1").alias("crossing"))


def lives(rows: DataFrame, entity: str, cycle: str, value: str, nominal: Column | None = None, reach: int = 2, tolerance: float | None = END_TOLERANCE, nearest: bool = False) -> DataFrame:
    """One row for each entity: counts, first, last and largest value, life under both definitions, flags.

    NaN and infinite values count as missing everywhere, and as non-finite in the flags.  ``nominal`` gives the nameplate
    value of an entity (an aggregate expression), null where unknown; then the measured initial value is the basis.  ``tolerance`` None switches off the acceptance of a series that ends just above.
    """
    rows = rows.withColumn(value, finite(F.col(value).cast("double")))
    w = Window.partitionBy(entity).orderBy(cycle)
    base = rows.select(entity, cycle, value, (F.col(value) - F.lag(value).over(w)).alias("step"))
    summary = base.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_cycles"), F.max_by(value, cycle).alias("final"), F.max(value).alias("top"), F.min("step").alias("drop"),
        F.max(cycle).cast("double").alias("last_cycle"), F.count_if(F.col(value).isNull()).alias("odd"),
    )
    named = rows.groupBy(entity).agg((F.lit(None).cast("double") if nominal is None else nominal).alias("nominal"))
    facts = summary.join(first_values(rows, entity, cycle, value), entity, "left").join(named, entity)
    curve = smoothed(rows, entity, cycle, value, reach).join(facts.select(entity, (END_SHARE * F.col("init")).alias("thr_init"), (END_SHARE * F.col("nominal")).alias("thr_nominal")), entity)
    by_init = crossing(curve, entity, cycle, "smooth", "thr_init", nearest).withColumnRenamed("crossing", "life_init")
    by_nominal = crossing(curve, entity, cycle, "smooth", "thr_nominal", nearest).withColumnRenamed("crossing", "life_nominal")
    out = facts.join(by_init, entity, "left").join(by_nominal, entity, "left")
    ends = lambda base: F.when(F.col("final") <= END_SHARE * F.col(base) * (1 + (tolerance or 0.0)), F.col("last_cycle")) if tolerance is not None else F.lit(None).cast("double")
    known = F.coalesce(F.col("nominal") > 0, F.lit(False))
    out = out.withColumn("life_init", F.coalesce("life_init", ends("init"))).withColumn("life_nominal", F.when(known, F.coalesce("life_nominal", ends("nominal"))))
    out = out.withColumn("basis", F.when(known, "nominal").otherwise("initial_capacity")).withColumn("life", F.when(known, F.col("life_nominal")).otherwise(F.col("life_init")))
    flags = F.concat_ws(
        ",",
        F.when(F.col("n_cycles") < SHORT_SERIES, "short_series"),
        F.when(F.col("odd") > 0, "non_finite_capacity"),
        F.when(known & (F.col("top") > 1.2 * F.col("nominal")), "capacity_gt_nominal"),
        F.when(known & (F.col("init") < 0.5 * F.col("nominal")), "low_initial_capacity"),
        F.when((F.col("n_cycles") > 2) & (F.col("init") > 0) & (F.col("drop") < -0.15 * F.col("init")), "capacity_spike_down"),
        F.when(F.col("life").isNull(), "no_eol_reached"),
    )
    return out.withColumn("flags", flags).withColumn("anomalous", anomalous(F.col("flags")))


def anomalous(flags: Column) -> Column:
    """Whether a comma-joined list has one of the anomaly flags."""
    return F.arrays_overlap(F.split(flags, ","), F.array(*map(F.lit, ANOMALIES)))


def at_cycle(rows: DataFrame, entity: str, cycle: str, value: str, n: float) -> DataFrame:
    """(entity, at_n): the value at cycle n or at the nearest one, the earlier on a tie."""
    return rows.groupBy(entity).agg(F.min_by(value, F.struct(F.abs(F.col(cycle) - n), F.col(cycle))).alias("at_n"))


def early_features(rows: DataFrame, entity: str, cycle: str, value: str, lo: int = 2, hi: int = 100) -> DataFrame:
    """Scalars of the cycles lo..hi: slope, values at both ends and their ratio; raises if a later cycle gets in."""
    used = rows.where(F.col(cycle).between(lo, hi))
    guard = F.assert_true(F.max(cycle) <= hi, F.lit("a cycle beyond the boundary reached the features"))
    at = lambda n: F.min_by(value, F.struct(F.abs(F.col(cycle) - n), F.col(cycle)))
    out = used.groupBy(entity).agg(
        F.regr_slope(value, cycle).alias("slope"), at(lo).alias("at_lo"), at(hi).alias("at_hi"), F.count(F.lit(1)).alias("n"), guard.alias("guard")
    )
    return out.drop("guard").withColumn("ratio", F.col("at_hi") / F.nullif("at_lo", F.lit(0.0)))


def curve_difference(rows: DataFrame, early: str, late: str) -> DataFrame:
    """``rows`` with log10 of the population variance and of the least value of late - early, two array columns."""
    d = F.zip_with(late, early, lambda x, y: x - y)
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d)
    variance = F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x) / F.size(d) - mean * mean
    return rows.withColumn("var_difference", F.log10(variance)).withColumn("min_difference", F.log10(F.abs(F.array_min(d))))


def gap_runs(rows: DataFrame, entity: str, time: Column, gap: float) -> DataFrame:
    """``rows`` with ``run``: a number that grows where more than ``gap`` lies between two rows of an entity."""
    timed = rows.withColumn("time__", time)
    w = Window.partitionBy(entity).orderBy("time__")
    new = (F.col("time__") - F.lag("time__").over(w) > gap).cast("int")
    return timed.withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(w)).drop("time__")


def longest_run(runs: DataFrame, entity: str) -> DataFrame:
    """(entity, run, n): the longest run, the first on a tie."""
    return runs.groupBy(entity, "run").agg(F.count(F.lit(1)).alias("n")).groupBy(entity).agg(F.max(F.struct("n", (-F.col("run")).alias("minus"))).alias("best")).select(
        entity, (-F.col("best.minus")).alias("run"), F.col("best.n").alias("n")
    )


def interpolated(knots: DataFrame, entity: str, x: str, y: str, grid: DataFrame, clamp: bool = True) -> DataFrame:
    """(entity, g, y): linear interpolation of each entity's knots at the grid points (entity, g).

    Outside the knots the end values hold, or null without ``clamp``.  The join is by entity and segment.
    """
    w = Window.partitionBy(entity).orderBy(x)
    ends = Window.partitionBy(entity)
    seg = knots.select(
        entity, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.min(x).over(ends).alias("lo")
    )
    inside = (F.col("g") >= F.col("x0")) & (F.col("g") < F.coalesce(F.col("x1"), F.lit(float("inf"))))
    below = (F.col("g") < F.col("lo")) & (F.col("x0") == F.col("lo"))
    line = F.col("y0") + (F.col("g") - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    edge = F.col("y0") if clamp else F.when(F.col("g") == F.col("x0"), F.col("y0"))
    at = F.when((F.col("g") < F.col("lo")) | F.col("x1").isNull(), edge).otherwise(line)
    return grid.join(seg, entity).where(inside | below).select(entity, "g", at.alias("y"))


def continued(rows: DataFrame, entity: str, cycle: str, continuations: DataFrame) -> DataFrame:
    """Series continued in another entity become one.

    ``continuations`` has (entity, next): rows of ``next`` move behind ``entity`` with their cycles shifted by the *number*
    of its rows, and where a cycle then occurs twice the first series' row stays.
    """
    sizes = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("offset"))
    links = continuations.select(F.col("entity").alias("into"), F.col("next").alias(entity)).join(sizes.withColumnRenamed(entity, "into"), "into")
    moved = rows.join(links, entity).withColumn(entity, F.col("into")).withColumn(cycle, F.col(cycle) + F.col("offset")).select(rows.columns)
    own = rows.join(links.select(entity), entity, "left_anti")
    both = own.withColumn("late", F.lit(0)).unionByName(moved.withColumn("late", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(entity, cycle).orderBy("late"))
    return both.withColumn("nth", first).where("nth = 1").select(rows.columns)
