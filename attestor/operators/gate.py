"""When to withhold a prediction: thresholds, risk-coverage curves, costs.

Predictions are rows with a coverage, a true and a predicted log10 value and a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.graph import grouped, loo_coverage, top_edges, without_each
from attestor.operators.stats import quantiles, running_totals
from attestor.storage import stored


def squared_error(true_log: str, predicted_log: str) -> Column:
    """Squared error of the back-transformed values."""
    return F.pow(F.pow(F.lit(10.0), F.col(true_log)) - F.pow(F.lit(10.0), F.col(predicted_log)), F.lit(2.0))


def risk_coverage(rows: DataFrame, coverage: str, square: str) -> DataFrame:
    """Per distinct threshold: how many rows have at least that coverage, their share, and their RMSE.

    One total per threshold and running sums over the thresholds, instead of a comparison of every row with each.
    """
    return _retained(rows.groupBy(F.col(coverage).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("sq")))


def _retained(totals: DataFrame, within: str | None = None) -> DataFrame:
    """The curve of totals (threshold, n, sq), for each group ``within``."""
    groups = [within] if within else []
    every = totals.groupBy(*groups).agg(F.sum("n").alias("all"))
    summed = running_totals(totals, "threshold", {"n_retained": "n", "s": "sq"}, descending=True, within=within)
    out = summed.join(every, groups) if within else summed.join(F.broadcast(every))
    return out.select(*groups, "threshold", "n_retained", (F.col("n_retained") / F.col("all")).alias("frac_retained"), F.sqrt(F.col("s") / F.col("n_retained")).alias("rmse_retained"))


def area(curve: DataFrame, lo: float = 0.2, hi: float = 1.0, points: int = 161, within: str | None = None) -> DataFrame:
    """(within, aurc): the mean risk over a grid of retentions, by trapezoids of the interpolated curve, held at its ends.

    Of the curve only the first and last point between two grid points matter, so windows hold ``points`` rows each.
    """
    step, groups = (hi - lo) / (points - 1), [within] if within else []
    x, y = F.col("frac_retained"), F.col("rmse_retained")
    cell = F.greatest(F.lit(0), F.least(F.lit(points), F.floor((x - lo) / step) + 1))  # cell i lies below grid point i
    point = F.struct(x.alias("x"), y.alias("y"))
    ends = curve.groupBy(*groups, cell.alias("i")).agg(F.min_by(point, x).alias("first"), F.max_by(point, x).alias("last"))
    grid = curve.sparkSession.range(points + 1).withColumnRenamed("id", "i")
    grid = curve.select(*groups).distinct().join(F.broadcast(grid)) if within else grid
    w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("i")
    under = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    on = grid.join(ends, [*groups, "i"], "left").select(*groups, "i", (lo + F.col("i") * step).alias("g"), under.alias("a"), over.alias("b")).where(F.col("i") < points)
    between = F.col("a.y") + (F.col("g") - F.col("a.x")) / (F.col("b.x") - F.col("a.x")) * (F.col("b.y") - F.col("a.y"))
    held = on.select(*groups, "i", "g", F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (F.col("a.x") == F.col("g")), F.col("a.y")).otherwise(between).alias("y"))
    pieces = held.select(*groups, ((F.col("y") + F.lead("y").over(w)) / 2 * (F.lead("g").over(w) - F.col("g"))).alias("a"))
    return pieces.groupBy(*groups).agg((F.sum("a") / (hi - lo)).alias("aurc"))


def drawn_folds(folds: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(rep, fold, times): how often each replicate draws each fold (with replacement), by a hash of replicate and place."""
    numbered = folds.withColumn("i", F.row_number().over(Window.orderBy("fold")) - 1)  # a row for each fold
    size = folds.agg(F.count(F.lit(1)).alias("folds"))
    draws = folds.sparkSession.range(replicates).withColumnRenamed("id", "rep").join(F.broadcast(size)).select("rep", "folds", F.explode(F.sequence(F.lit(0), F.col("folds").cast("int") - 1)).alias("place"))
    drawn = draws.groupBy("rep", F.pmod(F.xxhash64("rep", "place", F.lit(seed)), F.col("folds")).cast("int").alias("i")).agg(F.count(F.lit(1)).alias("times"))
    return drawn.join(numbered, "i").select("rep", "fold", "times")


def _interval(point: DataFrame, areas: DataFrame) -> DataFrame:
    return point.select(F.col("aurc").alias("point")).join(quantiles(areas, "aurc", {"lo": 0.025, "hi": 0.975}))


def bootstrap_area(rows: DataFrame, coverage: str, square: str, fold: str = "fold", replicates: int = 200, seed: int = 42) -> DataFrame:
    """(point, n, lo, hi): the area under the risk-coverage curve and its 95 % interval over folds drawn with replacement.

    A replicate weighs each fold's totals by how often its hash draws the fold, so no row is copied.
    """
    totals = rows.groupBy(F.col(fold).alias("fold"), F.col(coverage).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("sq"))
    totals = stored(totals, "fold-totals")
    whole = totals.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("sq").alias("sq"))
    picked = totals.join(drawn_folds(totals.select("fold").distinct(), replicates, seed), "fold")
    each = picked.groupBy("rep", "threshold").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.sum(F.col("sq") * F.col("times")).alias("sq"))
    return _interval(area(_retained(whole)), area(_retained(each, "rep"), within="rep"))


def random_baseline(rows: DataFrame, key: str, square: str, draws: int = 50, seed: int = 42) -> DataFrame:
    """(n_retained, rmse_random): the mean RMSE of the first n rows, over ``draws`` orders by a hash of key and draw.

    Each order's sums are running totals, so a draw gives a random choice of every size at once.
    """
    each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), F.col(key).alias("key"), F.col(square).alias("sq"))
    placed = each.groupBy("draw", F.xxhash64("key", "draw", F.lit(seed)).alias("at")).agg(F.sum("sq").alias("sq"), F.count(F.lit(1)).alias("n"))
    sums = running_totals(placed, "at", {"n_retained": "n", "s": "sq"}, within="draw")
    return sums.groupBy("n_retained").agg(F.avg(F.sqrt(F.col("s") / F.col("n_retained"))).alias("rmse_random"))


def risk_coverage_random(rows: DataFrame, key: str, coverage: str, square: str, draws: int = 50, seed: int = 42) -> DataFrame:
    """``risk_coverage`` with the RMSE of random choices of the same size beside it."""
    return risk_coverage(rows, coverage, square).join(random_baseline(rows, key, square, draws, seed), "n_retained", "left")


def fold_banks(edges: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """(fold, id, coverage): leave-one-group-out coverage within the training bank of every fold.

    Sources of the held-out group leave with it; what a bank row may count are the edges to neither its own nor the
    held-out group.
    """
    folds = groups.agg(F.collect_set("grp").alias("folds"))
    known = grouped(edges, groups).where("src_grp <> dst_grp")
    usual = top_edges(known, k).groupBy("src").agg(F.sum("weight").alias("usual"))
    own = without_each(known, k).groupBy("fold", F.col("src").alias("id")).agg(F.sum("weight").alias("own"))
    # a fold may also leave a source without any edge: then it has a row here and none in ``own``
    touched = known.select(F.col("src").alias("id"), F.col("dst_grp").alias("fold")).distinct().join(own, ["fold", "id"], "left").select("fold", "id", F.coalesce("own", F.lit(0.0)).alias("own"))
    bank = groups.join(F.broadcast(folds)).select(F.explode(F.array_except("folds", F.array("grp"))).alias("fold"), "id")
    both = bank.join(usual.withColumnRenamed("src", "id"), "id", "left").join(touched, ["fold", "id"], "left")
    return both.select("fold", "id", F.coalesce("own", "usual", F.lit(0.0)).alias("coverage"))


def fold_thresholds(banks: DataFrame, q: float) -> DataFrame:
    """(fold, threshold): the q-th percentile (linear) of each fold's bank."""
    return quantiles(banks, "coverage", {"threshold": q / 100}, "fold").select("fold", "threshold")


def decisions(predictions: DataFrame, thresholds: DataFrame, coverage: str = "coverage") -> DataFrame:
    """Predictions with ``retained``: coverage at or above the threshold of the row's fold."""
    return predictions.join(F.broadcast(thresholds), "fold").withColumn("retained", F.col(coverage) >= F.col("threshold"))


def quantile_curve(predictions: DataFrame, banks: DataFrame, qs: list[float], square: str) -> DataFrame:
    """Per q: threshold (median over folds), retention, RMSE and share of the total error of the rows that stay."""
    arrays = quantiles(banks, "coverage", {f"q{i}": q / 100 for i, q in enumerate(qs)}, "fold").select("fold", F.array(*[f"q{i}" for i in range(len(qs))]).alias("t"))
    cuts = arrays.select("fold", F.posexplode("t").alias("i", "threshold")).select("fold", "threshold", F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1).alias("q"))
    each = predictions.join(F.broadcast(cuts), "fold")
    keep = F.col("coverage") >= F.col("threshold")
    kept = F.count_if(keep)
    out = each.groupBy("q").agg(
        (kept / F.count(F.lit(1))).alias("retention"), F.sqrt(F.sum(F.when(keep, F.col(square))) / F.nullif(kept, F.lit(0))).alias("rmse"),
        (F.coalesce(F.sum(F.when(keep, F.col(square))), F.lit(0.0)) / F.sum(square)).alias("error_share"),
    )
    return out.join(cuts.groupBy("q").agg(F.percentile("threshold", F.lit(0.5)).alias("threshold")), "q")


def cheapest(curve: DataFrame, ratios: list[float]) -> DataFrame:
    """(ratio, q, cost): per cost ratio the q with the least ratio * withheld + served error, the smaller q on a tie."""
    table = curve.sparkSession.createDataFrame([(r,) for r in ratios], "ratio double")
    cost = F.col("ratio") * (1 - F.col("retention")) + F.col("error_share")
    best = curve.crossJoin(F.broadcast(table)).groupBy("ratio").agg(F.min(F.struct(F.round(cost, 9).alias("cost"), "q")).alias("best"))
    return best.select("ratio", "best.q", "best.cost")


def excess_cost(curve: DataFrame, ratios: list[float], q: float) -> DataFrame:
    """(ratio, cost, least, excess_pct): what one q of the curve costs beyond the best one, for each cost ratio."""
    table = curve.sparkSession.createDataFrame([(r,) for r in ratios], "ratio double")
    cost = F.col("ratio") * (1 - F.col("retention")) + F.col("error_share")
    each = curve.crossJoin(F.broadcast(table)).groupBy("ratio").agg(F.max(F.when(F.col("q") == q, cost)).alias("cost"), F.min(cost).alias("least"))
    return each.select("ratio", "cost", "least", (100 * (F.col("cost") / F.nullif("least", F.lit(0.0)) - 1)).alias("excess_pct"))


def implied_ratio(curve: DataFrame, ratios: list[float], q: float, tolerance: float = 5.0) -> DataFrame:
    """One row: the cost ratios at which q is the optimum, those where it costs at most ``tolerance`` per cent more, the
    ratio whose optimum is closest to q, and where its excess is least; the smaller ratio on a tie."""
    both = cheapest(curve, ratios).select("ratio", F.col("q").alias("best_q")).join(excess_cost(curve, ratios, q), "ratio")
    hit, near, gap = F.col("best_q") == q, F.col("excess_pct") <= tolerance, F.abs(F.col("best_q") - q)
    at = lambda cond, agg: agg(F.when(cond, F.col("ratio")))
    return both.agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("exactly_optimal"), at(hit, F.min).alias("ratio_lo"), at(hit, F.max).alias("ratio_hi"),
        F.min_by("ratio", F.struct(gap, "ratio")).alias("closest_ratio"), F.min_by("best_q", F.struct(gap, "ratio")).alias("closest_q"),
        F.min("excess_pct").alias("min_excess_pct"), F.min_by("ratio", F.struct(F.round("excess_pct", 6), "ratio")).alias("ratio_at_min_excess"),
        at(near, F.min).alias("near_lo"), at(near, F.max).alias("near_hi"),
    )


def bank_threshold(edges: DataFrame, groups: DataFrame, q: float, k: int = 5, least: int = 5) -> DataFrame:
    """(grp, n, threshold, whole): per group its own percentile, or the whole bank's where it has under ``least`` rows."""
    bank = loo_coverage(edges, groups, k)
    own = quantiles(bank, "coverage", {"own": q / 100}, "grp")
    everyone = quantiles(bank, "coverage", {"everyone": q / 100}).select("everyone")
    small = F.col("n") < least
    return own.join(F.broadcast(everyone)).select("grp", "n", F.when(small, F.col("everyone")).otherwise(F.col("own")).alias("threshold"), small.alias("whole"))


def percentile_of(scores: DataFrame, banks: DataFrame) -> DataFrame:
    """(fold, id, percentile): the mean percentile rank of each score within its fold's bank."""
    seen = banks.select("fold", "coverage", F.lit(1).alias("bank")).unionByName(scores.select("fold", "coverage", F.lit(0).alias("bank")))
    counts = running_totals(seen.groupBy("fold", "coverage").agg(F.sum("bank").alias("same")), "coverage", {"upto": "same"}, within="fold")
    sizes = banks.groupBy("fold").agg(F.count("coverage").alias("n"))
    rank = (2 * F.col("upto") - F.col("same")) / 2 / F.nullif("n", F.lit(0)) * 100
    return scores.select("fold", "id", "coverage").join(counts, ["fold", "coverage"]).join(sizes, "fold").select("fold", "id", rank.alias("percentile"))


def hybrid_folds(rows: DataFrame, n: int, levels: list[float], coverage: str = "coverage", spread: str = "spread", square: str = "square") -> DataFrame:
    """(level, fold, n, kept, error): what a gate on coverage and spread together keeps of each fold, and its squared error.

    For each fold the pair of thresholds is chosen on the other folds alone: least RMSE among pairs that retain the level,
    then higher retention, then the lower coverage and higher spread threshold.  Sums per fold and pair make the other
    folds' figures a subtraction.
    """
    points, low, high = {f"q{i}": i / (n - 1) for i in range(n)}, float("-inf"), float("inf")
    cuts = lambda column: sorted(set(quantiles(rows, column, points).select(*points).first() or ()))  # noqa: E731  n numbers
    t_cov, t_spr = [low, *cuts(coverage)], [*cuts(spread), high]
    above = lambda column, at, meets: F.size(F.filter(F.array(*map(F.lit, at)), meets(F.col(column)))) - 1
    last_cov = above(coverage, t_cov, lambda x: lambda t: t <= x)
    first_spr = len(t_spr) - 1 - above(spread, t_spr, lambda x: lambda t: t >= x)
    cells = rows.groupBy("fold", last_cov.alias("a"), first_spr.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("error"))
    pairs = rows.sparkSession.createDataFrame([(i, x, j, y) for i, x in enumerate(t_cov) for j, y in enumerate(t_spr)], "i int, t_cov double, j int, t_spr double")
    # each row lies in one cell of the grid; a pair of thresholds keeps the cells up to its corner
    keep = (F.col("a") >= F.col("i")) & (F.col("b") <= F.col("j"))
    own = cells.join(F.broadcast(pairs)).groupBy("fold", "t_cov", "t_spr").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(keep, F.col("error"))), F.lit(0.0)).alias("error")
    )
    own = stored(own, "pairs")
    w = Window.partitionBy("t_cov", "t_spr")
    rest = own.select("*", *[(F.sum(c).over(w) - F.col(c)).alias(f"rest_{c}") for c in ("n", "kept", "error")])
    risk = F.when(F.col("rest_kept") > 0, F.round(F.sqrt(F.greatest(F.col("rest_error"), F.lit(0.0)) / F.col("rest_kept")), 6)).otherwise(float("inf"))
    ranked = rest.select("*", (F.col("rest_kept") / F.col("rest_n")).alias("share"), risk.alias("risk"))
    table = rows.sparkSession.createDataFrame([(x,) for x in levels], "level double")
    fit = ranked.join(F.broadcast(table), F.col("share") >= F.col("level") - 1e-12)
    order = F.struct("risk", (-F.col("share")).alias("s"), "t_cov", (-F.col("t_spr")).alias("t"))
    best = fit.groupBy("level", "fold").agg(F.min_by(F.struct("n", "kept", "error"), order).alias("b"))
    return best.select("level", "fold", "b.n", "b.kept", "b.error")


def _kept_curve(totals: DataFrame, *keys: str) -> DataFrame:
    """(keys, frac_retained, rmse_retained) of sums (n, kept, error)."""
    return totals.groupBy(*keys).agg((F.sum("kept") / F.sum("n")).alias("frac_retained"), F.sqrt(F.sum("error") / F.nullif(F.sum("kept"), F.lit(0))).alias("rmse_retained"))


def hybrid(rows: DataFrame, n: int, levels: list[float], coverage: str = "coverage", spread: str = "spread", square: str = "square") -> DataFrame:
    """(level, frac_retained, rmse_retained) of the gate of ``hybrid_folds`` over all folds."""
    return _kept_curve(hybrid_folds(rows, n, levels, coverage, spread, square), "level")


def bootstrap_hybrid(rows: DataFrame, n: int, levels: list[float], replicates: int = 200, seed: int = 42, **columns: str) -> DataFrame:
    """(point, n, lo, hi): the area under the hybrid gate's curve and its 95 % interval over folds drawn with replacement.

    The gate's decisions stay as they are; a replicate weighs the sums of each fold and level.  Levels that keep nothing are left
    out, and levels with equal retention count once, with their mean risk.
    """
    totals = stored(hybrid_folds(rows, n, levels, **columns), "hybrid-folds")
    drawn = totals.join(drawn_folds(totals.select("fold").distinct(), replicates, seed), "fold")
    weighed = drawn.select("rep", "level", *[(F.col(c) * F.col("times")).alias(c) for c in ("n", "kept", "error")])
    once = lambda curve, *keys: curve.where("rmse_retained is not null").groupBy(*keys, "frac_retained").agg(F.avg("rmse_retained").alias("rmse_retained"))
    return _interval(area(once(_kept_curve(totals, "level"))), area(once(_kept_curve(weighed, "rep", "level"), "rep"), within="rep"))
