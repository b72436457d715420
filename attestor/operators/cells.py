"""From the raw steps of a cell to its tidy cycles and its early features, in one operator.

Steps are rows (cell, cycle, seq, status, capacity in mAh, voltage, time in seconds); discharging rows say so in their status.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points of a curve, at least so many of them, how far the grid stays from the curves' ends, the least variance.
GRID, LEAST_POINTS, MARGIN, FLOOR = 500, 10, 0.01, 1e-12


def _discharging(status: Column) -> Column:
    return F.lower(status).contains("discharge")


def tidy_cycles(steps: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(cell, cycle, discharge_capacity_ah, charge_min): cycles with a positive finite discharge.

    Under two rows of a kind give no value.  ``skipped`` (cell, n) says how many first cycles of a cell are left out.
    """
    out = _discharging(F.col("status"))
    in_ = F.lower("status").contains("charge") & ~out
    at = lambda pick, v, where: pick(v, F.when(where, F.col("seq")))
    rows = steps.groupBy("cell", "cycle").agg(
        F.when(F.count_if(out) >= 2, (at(F.min_by, "capacity", out) - at(F.max_by, "capacity", out)) / 1000).alias("discharge_capacity_ah"),
        F.when(F.count_if(in_) >= 2, (at(F.max_by, "time", in_) - at(F.min_by, "time", in_)) / 60).alias("charge_min"),
    )
    if skipped is not None:
        nth = F.row_number().over(Window.partitionBy("cell").orderBy("cycle"))
        rows = rows.withColumn("nth", nth).join(F.broadcast(skipped.select("cell", F.col("n").alias("skip"))), "cell", "left").where("nth > coalesce(skip, 0)").drop("nth", "skip")
    good = F.col("discharge_capacity_ah")
    return rows.where((good > 0) & (good < float("inf")) & ~F.isnan(good))


def curves_of(rows: DataFrame, least: int = 0) -> DataFrame:
    """(cell, cycle, points): voltage and charge drawn so far of discharging rows, by voltage; under ``least`` points are none."""
    w = Window.partitionBy("cell", "cycle").orderBy("seq")
    drawn = rows.withColumn("q", (F.first("capacity").over(w) - F.col("capacity")) / 1000)
    curves = drawn.groupBy("cell", "cycle").agg(F.array_sort(F.collect_list(F.struct(F.col("voltage").alias("v"), "seq", "q"))).alias("p"))  # one cycle's rows
    return curves.where(F.size("p") >= least).select("cell", "cycle", F.transform("p", lambda x: F.struct(x["v"].alias("v"), x["q"].alias("q"))).alias("points"))


def discharge_curves(steps: DataFrame, cycles: list[int], least: int = LEAST_POINTS) -> DataFrame:
    """The curves of the given cycles."""
    return curves_of(steps.where(F.col("cycle").isin(cycles) & _discharging(F.col("status"))), least)


def curve_scalars(early: Column, late: Column, grid: int = GRID) -> Column:
    """struct<var, least>: population variance and least value of late - early on a common grid of voltages."""

    @F.pandas_udf("struct<var:double,least:double>")
    def scalars(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in parts:
            out = []
            for x, y in zip(a, b, strict=True):
                if x is None or y is None or len(x) == 0 or len(y) == 0:
                    out.append((None, None))
                    continue
                (v0, q0), (v1, q1) = (np.array([(p["v"], p["q"]) for p in c], float).T for c in (x, y))
                at = np.linspace(max(v0.min(), v1.min()) + MARGIN, min(v0.max(), v1.max()) - MARGIN, grid)
                d = np.interp(at, v1, q1) - np.interp(at, v0, q0)
                out.append((float(d.var()), float(d.min())))
            yield pd.DataFrame(out, columns=["var", "least"], dtype=float)

    return scalars(early, late)


def features(tidy: DataFrame, curves: DataFrame, early: int, late: int, slope_lo: int, last: int, grid: int = GRID) -> DataFrame:
    """The seven early features of every cell that has both curves; raises if a cycle beyond ``last`` is asked for.

    Slope over cycles slope_lo to last, capacity at slope_lo and late (or the nearest cycle, the earlier on a tie), their
    ratio, the mean charging time, and log10 of variance and least value of the difference of both curves.
    """
    if max(early, late) > last:
        raise ValueError(f"curves of cycles {early} and {late} lie beyond the boundary {last}")
    inside, cap = F.col("cycle").between(slope_lo, last), F.col("discharge_capacity_ah")
    at = lambda n: F.min_by(cap, F.struct(F.abs(F.col("cycle") - n), F.col("cycle")))
    scalars = tidy.groupBy("cell").agg(
        F.regr_slope(F.when(inside, cap), F.when(inside, F.col("cycle"))).alias("slope"), at(slope_lo).alias("capacity_early"), at(late).alias("capacity_late"),
        F.avg(F.when(F.col("cycle") <= last, F.col("charge_min"))).alias("mean_charge_min"),
    )
    of = lambda n, name: curves.where(F.col("cycle") == n).select("cell", F.col("points").alias(name))
    both = of(early, "a").join(of(late, "b"), "cell").select("cell", curve_scalars(F.col("a"), F.col("b"), grid).alias("d"))
    log = lambda x: F.log10(F.greatest(x, F.lit(FLOOR)))
    out = scalars.join(both, "cell").withColumn("cap_ratio", F.col("capacity_late") / F.nullif("capacity_early", F.lit(0.0)))
    return out.select("cell", log(F.col("d.var")).alias("var_dq"), log(F.abs("d.least")).alias("min_dq"), "slope", "capacity_early", "capacity_late", "cap_ratio", "mean_charge_min")


def processed(steps: DataFrame, early: int, late: int, slope_lo: int, last: int, skipped: DataFrame | None = None, grid: int = GRID) -> tuple[DataFrame, DataFrame]:
    """The tidy cycles and the early features of all cells."""
    tidy = tidy_cycles(steps, skipped)
    used = steps if skipped is None else steps.join(tidy.select("cell", "cycle"), ["cell", "cycle"], "left_semi")
    return tidy, features(tidy, discharge_curves(used, [early, late]), early, late, slope_lo, last, grid)


def surrogate_pair(steps: DataFrame, least: int, gap: int) -> DataFrame:
    """(cell, first, second): the first densely sampled cycle of a cell and the first one at least ``gap`` later, else the last.

    Cycles count as dense with more than ``least`` discharging rows; cells with one such cycle or none have no pair.
    """
    dense = steps.where(_discharging(F.col("status"))).groupBy("cell", "cycle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    first = dense.groupBy("cell").agg(F.min("cycle").alias("first"), F.max("cycle").alias("last"), F.count(F.lit(1)).alias("dense")).where("dense > 1")
    far = dense.join(first, "cell").where(F.col("cycle") - F.col("first") >= gap).groupBy("cell").agg(F.min("cycle").alias("far"))
    return first.join(far, "cell", "left").select("cell", "first", F.coalesce("far", "last").alias("second"))


def surrogate_features(steps: DataFrame, tidy: DataFrame, least: int, gap: int, grid: int = GRID) -> DataFrame:
    """(cell, first, second, var_dq, min_dq, slope, capacity_early, capacity_late, cap_ratio) of each cell's own pair of cycles.

    Curves are those of the longest unbroken discharge of a cycle; capacities are the cell's first one and the one nearest to
    the second cycle, the slope that of the cycles between both, from three of them on.
    """
    pair = surrogate_pair(steps, least, gap)
    chosen = steps.join(pair.select("cell", F.explode(F.array("first", "second")).alias("cycle")).distinct(), ["cell", "cycle"])
    w = Window.partitionBy("cell", "cycle").orderBy("seq")
    out = _discharging(F.col("status"))
    island = chosen.withColumn("out", out).withColumn("run", F.sum(F.when(out, 0).otherwise(1)).over(w)).where("out")
    longest = island.groupBy("cell", "cycle", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("cell", "cycle").agg(F.max_by("run", F.struct("n", -F.col("run"))).alias("run"))
    curves = curves_of(island.join(longest, ["cell", "cycle", "run"]))
    of = lambda c, name: pair.select("cell", F.col(c).alias("cycle")).join(curves, ["cell", "cycle"]).select("cell", F.col("points").alias(name))
    d = of("first", "a").join(of("second", "b"), "cell").select("cell", curve_scalars(F.col("a"), F.col("b"), grid).alias("d"))
    cap, between = F.col("discharge_capacity_ah"), F.col("cycle").between(F.col("first"), F.col("second"))
    caps = tidy.join(pair, "cell").groupBy("cell", "first", "second").agg(
        F.min_by(cap, "cycle").alias("capacity_early"), F.min_by(cap, F.struct(F.abs(F.col("cycle") - F.col("second")), "cycle")).alias("capacity_late"),
        F.when(F.count_if(between) > 2, F.regr_slope(F.when(between, cap), F.when(between, F.col("cycle")))).alias("slope"),
    )
    log = lambda x: F.log10(F.greatest(x, F.lit(FLOOR)))
    return caps.join(d, "cell").select("cell", "first", "second", log(F.col("d.var")).alias("var_dq"), log(F.abs("d.least")).alias("min_dq"), "slope", "capacity_early", "capacity_late", (F.col("capacity_late") / F.nullif("capacity_early", F.lit(0.0))).alias("cap_ratio"))


def instances(lives: DataFrame, early: DataFrame, described: DataFrame, study: str) -> DataFrame:
    """One row for each usable cell of a study: life, features, what is known about it and a dense group number of its policy.

    ``lives`` has (cell, life, init, last_cycle, anomalous), ``described`` (cell, policy).  Anomalous cells go; a cell without a life is
    censored at its last cycle.  Groups are numbered by name; cells without a policy have none.
    """
    names = described.select("policy").where("policy is not null").distinct()
    numbered = names.select("policy", F.concat(F.lit("pg"), F.lpad((F.dense_rank().over(Window.orderBy("policy")) - 1).cast("string"), 3, "0")).alias("policy_group"))  # a row for each policy
    rows = lives.where(~F.coalesce("anomalous", F.lit(False))).join(described, "cell", "left").join(F.broadcast(numbered), "policy", "left").join(early, "cell", "left")
    censored = F.col("life").isNull()
    kept = [c for c in early.columns if c != "cell"]
    return rows.select(
        F.concat(F.lit(f"{study}_"), F.col("cell").cast("string")).alias("instance_id"), F.lit(study).alias("study"), "cell", "policy", "policy_group", F.coalesce("life", F.col("last_cycle").cast("double")).alias("cycles"),
        censored.alias("censored"), F.col("init").alias("initial_capacity_ah"), *kept,
    )


def evidence(rows: DataFrame, tidy: DataFrame, nominal: float, tolerance: float = 0.1) -> DataFrame:
    """One row on what the data say about the cells' identity: how many, their first capacities against the claimed one, and
    on what the match rests: a signature that fits, or only what was published."""
    cap = F.col("initial_capacity_ah")
    close = F.abs(cap - nominal) <= tolerance * nominal
    of = rows.agg(
        F.count(F.lit(1)).alias("cells_matched"), F.min(cap).alias("least_initial"), F.max(cap).alias("most_initial"), F.count_if(close).alias("near_nominal"), F.count_if(cap < nominal).alias("below_nominal"),
        F.countDistinct("policy_group").alias("groups"), F.count_if("censored").alias("censored"),
    )
    basis = F.when(F.col("near_nominal") == F.col("cells_matched"), "signature_consistent").otherwise("asserted_from_publication")
    return of.join(tidy.agg(F.count(F.lit(1)).alias("rows_ingested"))).withColumn("identity_basis", basis)
