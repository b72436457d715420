"""How a gate adapts to a new study when some of its rows join the bank: all draws in one plan, the draw being a key.

A draw is a number of added rows and a seed.  Its bank is the known study and the rows of the new one with the smallest hashes
of id and seed; the other new rows are judged.  Scaling, nearest rows, thresholds and figures are all computed for every draw
at once, each within its own key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.graph import nearest, top_edges
from attestor.operators.stats import quantiles, running_totals
from attestor.storage import stored

# Rows that a study needs for a threshold of its own, and retained rows that a rank correlation needs.
LEAST_REFERENCES, LEAST_FOR_RANKS = 5, 10
WHOLE, STRATIFIED = "whole_bank", "same_study"


def draws(known: DataFrame, new: DataFrame, sizes: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """(draw, n_added, seed, in_bank, study, id, grp, y, x): every draw's bank and judged rows.

    ``known`` and ``new`` have (id, grp, y, x), x being an array.  A size above the number of new rows takes them all.
    """
    table = known.sparkSession.createDataFrame([(i, n, s) for i, (n, s) in enumerate((n, s) for n in sizes for s in seeds)], "draw int, n_added int, seed int")
    columns = ["id", "grp", "y", "x"]
    old = known.select(*columns).join(F.broadcast(table)).select("draw", "n_added", "seed", F.lit(True).alias("in_bank"), F.lit("known").alias("study"), *columns)
    every = new.select(*columns).join(F.broadcast(table)).withColumn("at", F.xxhash64("id", "seed"))
    # running counts over each draw's hashes; its rows are those up to which the count stays within its size
    placed = running_totals(every.groupBy("draw", "at").agg(F.count(F.lit(1)).alias("one")), "at", {"upto": "one"}, within="draw")
    ranked = every.join(placed.select("draw", "at", "upto"), ["draw", "at"])
    chosen = ranked.select("draw", "n_added", "seed", (F.col("upto") <= F.col("n_added")).alias("in_bank"), F.lit("new").alias("study"), *columns)
    return old.unionByName(chosen)


def scaled(rows: DataFrame, features: int) -> DataFrame:
    """``rows`` with x as z-scores by the mean and population deviation of their draw's bank."""
    x = lambda j: F.get("x", F.lit(j))
    stats = rows.where("in_bank").groupBy("draw").agg(
        F.array(*[F.avg(x(j)) for j in range(features)]).alias("m"), F.array(*[F.stddev_pop(x(j)) for j in range(features)]).alias("s")
    )
    z = F.transform("x", lambda v, j: (v - F.get("m", j)) / F.when(F.get("s", j) == 0, 1.0).otherwise(F.get("s", j)))
    return rows.join(F.broadcast(stats), "draw").withColumn("vec", z).drop("m", "s", "x")


def judged(rows: DataFrame, k: int = 5) -> DataFrame:
    """(draw, id, y, coverage, predicted) of the rows outside the banks: the sum of their k best weights and the weighted mean."""
    bank = rows.where("in_bank")
    edges = nearest(rows.where("not in_bank"), bank, k, within="draw")
    known = edges.join(bank.select("draw", F.col("id").alias("dst"), "y"), ["draw", "dst"])
    mean = known.groupBy("draw", F.col("src").alias("id")).agg(F.sum("weight").alias("coverage"), (F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("predicted"))
    return rows.where("not in_bank").select("draw", "id", "y").join(mean, ["draw", "id"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def thresholds(rows: DataFrame, q: float, k: int = 5) -> DataFrame:
    """(draw, rule, threshold, source): a percentile of the bank's leave-one-out coverage by two rules.

    The whole bank counts without its own groups.  The new study's own rows count with their groups, as nothing is held
    out when they are served; with fewer than ``LEAST_REFERENCES`` of them the whole bank decides.
    """
    bank = rows.where("in_bank")

    def percentile(own: DataFrame, exclude_group: bool, name: str) -> DataFrame:
        sums = top_edges(nearest(own, bank, k, exclude_group=exclude_group, within="draw"), k, "draw").groupBy("draw", F.col("src").alias("id")).agg(F.sum("weight").alias("c"))
        each = own.select("draw", "id").join(sums, ["draw", "id"], "left").select("draw", F.coalesce("c", F.lit(0.0)).alias("c"))
        return quantiles(each, "c", {name: q / 100}, "draw").withColumnRenamed("n", f"n_{name}")

    whole = percentile(bank, True, "whole")
    both = whole.join(percentile(bank.where("study = 'new'"), False, "own"), "draw", "left")
    enough = F.coalesce(F.col("n_own") >= LEAST_REFERENCES, F.lit(False))
    rules = F.array(
        F.struct(F.lit(WHOLE).alias("rule"), F.col("whole").alias("threshold"), F.lit(WHOLE).alias("source")),
        F.struct(F.lit(STRATIFIED).alias("rule"), F.when(enough, F.col("own")).otherwise(F.col("whole")).alias("threshold"), F.when(enough, STRATIFIED).otherwise(f"fallback:{WHOLE}").alias("source")),
    )
    return both.select("draw", F.inline(rules))


def _ranks(keys: list[str], column: str, out: str) -> Column:
    """Average ranks of a column within keys, the rows of one draw."""
    w = Window.partitionBy(*keys).orderBy(column)
    return (F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2).alias(out)


def figures(rows: DataFrame, cuts: DataFrame, cutoff: float = 30.0) -> DataFrame:
    """One row for each draw and rule: retention, errors of what is kept and withheld, false acceptance, useful and needless
    refusals, and the rank correlation of coverage and error among kept rows from ``LEAST_FOR_RANKS`` on.

    An error above ``cutoff`` per cent should not have been served.
    """
    each = rows.join(F.broadcast(cuts), "draw").withColumns({"kept": F.col("coverage") >= F.col("threshold"), "miss": F.abs(F.col("predicted") - F.col("y"))})
    bad = F.coalesce(100 * F.col("miss") / F.abs("y") > cutoff, F.lit(True))
    keys, kept = ["draw", "rule", "threshold", "source"], F.col("kept")
    rmse = lambda cond, name: F.sqrt(F.avg(F.when(cond, F.col("miss") * F.col("miss")))).alias(name)
    mape = lambda cond, name: F.avg(F.when(cond, 100 * F.col("miss") / F.abs("y"))).alias(name)
    out = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_eval"), F.count_if(kept).alias("n_retained"), (100 * F.count_if(kept) / F.count(F.lit(1))).alias("retention_pct"), rmse(kept, "rmse_retained"), mape(kept, "mape_retained"),
        rmse(~kept, "rmse_abstained"), rmse(F.lit(True), "rmse_all"), F.count_if(kept & bad).alias("false_acceptance"), F.count_if(~kept & bad).alias("useful_refusals"),
        F.count_if(~kept & ~bad).alias("needless_refusals"), F.avg("coverage").alias("mean_coverage"),
    )
    held = each.where("kept and miss is not null").select("draw", "rule", "coverage", "miss")
    ranked = held.select("draw", "rule", _ranks(["draw", "rule"], "coverage", "a"), _ranks(["draw", "rule"], "miss", "b"))
    rho = ranked.groupBy("draw", "rule").agg(F.count(F.lit(1)).alias("m"), F.corr("a", "b").alias("rho")).select("draw", "rule", F.when(F.col("m") >= LEAST_FOR_RANKS, F.col("rho")).alias("spearman"))
    return out.join(rho, ["draw", "rule"], "left")


def adapted(known: DataFrame, new: DataFrame, features: int, sizes: Sequence[int], seeds: Sequence[int], q: float, cutoff: float = 30.0, k: int = 5) -> DataFrame:
    """``figures`` of every number of added rows and seed, with (n_added, seed) in place of the draw."""
    rows = stored(scaled(draws(known, new, sizes, seeds), features), "draws")
    names = rows.select("draw", "n_added", "seed").distinct()
    out = figures(stored(judged(rows, k), "judged"), stored(thresholds(rows, q, k), "thresholds"), cutoff)
    return names.join(out, "draw").drop("draw")


def summary(rows: DataFrame) -> DataFrame:
    """(n_added, rule, repeats, mean and sample deviation of the figures) over the seeds."""
    columns = ("retention_pct", "rmse_retained", "rmse_abstained", "rmse_all", "false_acceptance", "useful_refusals", "needless_refusals", "spearman", "threshold")
    return rows.groupBy("n_added", "rule").agg(F.count(F.lit(1)).alias("repeats"), *[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])
