"""Statistics of agreement, error and survival."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.storage import stored

#: Rows of running totals, or of one group of them, that one sorted task may take; beyond, keys are dealt by ranges.
ONE_TASK = 1_000_000


def errors(true: Column, predicted: Column) -> list[Column]:
    """rmse, mape (per cent) and n."""
    return [F.sqrt(F.avg(F.pow(true - predicted, F.lit(2.0)))).alias("rmse"), (F.avg(F.abs(true - predicted) / F.abs(true)) * 100).alias("mape"), F.count(F.lit(1)).alias("n")]


def average_ranks(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the rank of a column, ties sharing their mean rank.

    Ranks come from running counts of distinct values, which are dealt by range, not from one sorted whole.
    """
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n__"))
    ranked = running_total(counts, column, "n__", "upto__")
    rank = F.col("upto__") - (F.col("n__") - 1) / 2
    return rows.join(ranked.select(column, rank.alias(out)), column)


def running_total(rows: DataFrame, key: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """``rows`` (one for each key) with the sum of ``value`` up to each key."""
    return running_totals(rows, key, {out: value}, parts=parts)


def running_totals(rows: DataFrame, key: str, sums: dict[str, str], descending: bool = False, within: str | None = None, parts: int | None = None, keep: bool = True) -> DataFrame:
    """``rows`` (one for each key, or key and group) with the sum of each value up to its key, ``sums`` naming result and value.

    The rows are stored first (unless ``keep`` is false, for stored ones), as they are read several times.  More than
    ``ONE_TASK`` of them, or of a group, are dealt by ranges of keys; a window runs within each range and the ranges' bases
    are added, so no long order is ever in one task.
    """
    rows = stored(rows, "totals") if keep else rows
    groups, last = [within] if within else [], F.desc if descending else F.asc
    size = rows.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    if parts is None and size <= ONE_TASK:
        upto = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(last(key)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[F.sum(v).over(upto).alias(o) for o, v in sums.items()])
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("b")).first()["b"] or []
    placed = rows.withColumn("part__", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(key))) if bounds else F.lit(0))
    totals = placed.groupBy(*groups, "part__").agg(*[F.sum(v).alias(f"t__{o}") for o, v in sums.items()])
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(last("part__")).rowsBetween(Window.unboundedPreceding, -1)  # ``parts`` rows a group
    bases = totals.select(*groups, "part__", *[F.coalesce(F.sum(f"t__{o}").over(before), F.lit(0)).alias(f"base__{o}") for o in sums])
    inside = Window.partitionBy(*groups, "part__").orderBy(last(key)).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(v).over(inside).alias(o) for o, v in sums.items()]).join(bases, [*groups, "part__"])
    return summed.withColumns({o: F.col(o) + F.col(f"base__{o}") for o in sums}).drop("part__", *[f"base__{o}" for o in sums])


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], group: str | None = None) -> DataFrame:
    """(group, n, ...): exact linear quantiles, named by ``shares``; rows without a group or value are left out.

    The values are stored first, as they are read several times.  Groups of at most ``ONE_TASK`` values go through running counts of their distinct
    values; of longer ones only the values around each quantile are put in order (see ``_long_ends``).
    """
    groups = [group] if group else []
    known = stored(rows.where(_known(value, *groups)).select(*groups, value), "values")
    return _quantiles(known, stored(_sizes(known, value, groups), "sizes"), value, shares, groups)


def _known(*columns: str) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def _sizes(rows: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """(group, n, least__, most__) of the known values."""
    return rows.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("least__"), F.max(value).alias("most__"))


def _quantiles(known: DataFrame, sizes: DataFrame, value: str, shares: dict[str, float], groups: list[str]) -> DataFrame:
    """``quantiles`` of stored values without nulls and of their stored ``_sizes``."""
    fewest, most = sizes.agg(F.min("n"), F.max("n")).first()
    if (most or 0) <= ONE_TASK:
        ends = _short_ends(known, sizes, value, shares, groups)
    elif fewest > ONE_TASK:
        ends = _long_ends(known, known, sizes, value, shares, groups, most)
    else:
        few = sizes.where(F.col("n") > ONE_TASK)  # each has many values
        part = lambda how: known.join(F.broadcast(few.select(*groups)), groups, how)
        ends = _long_ends(known, part("left_semi"), few, value, shares, groups, most).unionByName(_short_ends(part("left_anti"), sizes, value, shares, groups))
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    between = lambda name, p: F.col(f"lo__{name}") * (F.ceil(p) - p) + F.col(f"hi__{name}") * (p - F.floor(p))
    return ends.select(*groups, "n", *[F.when(F.floor(p) == F.ceil(p), F.col(f"lo__{name}")).otherwise(between(name, p)).alias(name) for name, p in place.items()])


def _short_ends(known: DataFrame, sizes: DataFrame, value: str, shares: dict[str, float], groups: list[str]) -> DataFrame:
    """(group, n, lo__name, hi__name): the values next to each quantile, from one order of the distinct values of each group."""
    upto = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = known.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n__")).withColumn("upto__", F.sum("n__").over(upto))
    both = counts.join(sizes, groups) if groups else counts.join(F.broadcast(sizes))
    at = lambda k: F.min(F.when(F.col("upto__") > k, F.col(value)))
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    return both.groupBy(*groups, "n").agg(*[c for name, p in place.items() for c in (at(F.floor(p)).alias(f"lo__{name}"), at(F.ceil(p)).alias(f"hi__{name}"))])


def _long_ends(known: DataFrame, long: DataFrame, sizes: DataFrame, value: str, shares: dict[str, float], groups: list[str], most: int) -> DataFrame:
    """``_short_ends`` of few long groups (``long`` has their rows alone): sketches bound where each quantile lies, and only the values within its bounds are counted one by one.

    One pass counts them and the values outside, these by the bounds between which they lie.  A sketch's error is checked by these counts; where it was
    too large for some group, wider bounds follow, none at last.  Bounds hold at most ``ONE_TASK`` rows of a group, equal values apart, which are one count.
    Both extremes are known from ``sizes``.
    """
    names, v = sorted((n for n, q in shares.items() if 0 < q < 1), key=shares.get), F.col(value)
    accuracy = max(1_000, 4 * most // ONE_TASK)
    place = F.get(F.array(*[F.lit(float(shares[n])) for n in names]), "share__") * (F.col("n") - 1)
    with_sizes = lambda d, other: d.join(F.broadcast(other), groups) if groups else d.join(F.broadcast(other))
    ends = None
    for margin in (2 / accuracy, 32 / accuracy, 2.0) if names else ():
        cuts = [(f"{side}__{i}", shares[n] + off) for i, n in enumerate(names) for side, off in (("from", -margin), ("to", margin))]
        asked = [(c, q) for c, q in cuts if 0 < q < 1]  # no bound where there is none
        placed = long
        if asked:
            sketch = long.groupBy(*groups).agg(F.percentile_approx(v, [q for _, q in asked], accuracy).alias("a__"))
            placed = with_sizes(known, stored(sketch.select(*groups, *[F.get("a__", F.lit(k)).alias(c) for k, (c, _) in enumerate(asked)]), "bounds"))
        met = lambda side, test: sum((test(F.col(f"{side}__{i}")).cast("int") if f"{side}__{i}" in dict(asked) else F.lit(int(side == "from")) for i in range(len(names))), F.lit(0))
        # bounds ascend with the shares: a value is within those from ``passed__`` on and before ``reached__``
        placed = placed.select(*groups, value, met("from", lambda b: v >= b).alias("reached__"), met("to", lambda b: v > b).alias("passed__"))
        near = F.when(F.col("passed__") < F.col("reached__"), v).alias(value)
        counts = stored(placed.groupBy(*groups, "passed__", "reached__", near).agg(F.count(F.lit(1)).alias("n__")), "counts")
        below = counts.groupBy(*groups).agg(F.array(*[F.sum(F.when(F.col("reached__") <= i, F.col("n__")).otherwise(0)) for i in range(len(names))]).alias("below__"))
        upto = Window.partitionBy(*groups, "share__").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        within = counts.where("passed__ < reached__").select(*groups, value, "n__", F.explode(F.expr("sequence(passed__, reached__ - 1)")).alias("share__"))
        ranked = with_sizes(with_sizes(within.withColumn("upto__", F.sum("n__").over(upto)), below), sizes).withColumns({"below__": F.get("below__", "share__"), "p__": place})
        end = lambda k: F.min(F.when(F.col("below__") + F.col("upto__") > k, v))
        ends = stored(ranked.groupBy(*groups, "share__").agg(end(F.floor("p__")).alias("lo__"), end(F.ceil("p__")).alias("hi__"), (F.first("below__") <= F.floor(F.first("p__"))).alias("fits__")), "ends")
        if ends.where("fits__ and hi__ is not null").count() == len(names) * sizes.count():
            break
    of = lambda n, c: F.max(F.when(F.col("share__") == names.index(n), F.col(c))).alias(f"{c}{n}")
    found = with_sizes(ends.groupBy(*groups).agg(*[of(n, c) for n in names for c in ("lo__", "hi__")]), sizes) if names else sizes
    extreme = {n: "least__" if q <= 0 else "most__" for n, q in shares.items() if n not in names}
    return found.select(*groups, "n", *[F.col(extreme.get(n, f"{c}{n}")).alias(f"{c}{n}") for n in shares for c in ("lo__", "hi__")])


def distribution(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, median, least, most, q1, q3): size, extremes and linear quartiles of each group, also of rows without one; null without values."""
    shares = {"median": 0.5, "least": 0.0, "most": 1.0, "q1": 0.25, "q3": 0.75}
    rows = stored(rows.select(group, value), "measured")
    sizes = stored(_sizes(rows, value, [group]), "sizes")
    unnamed = F.col(group).isNull()
    found = _quantiles(rows.where(_known(value, group)), sizes.where(~unnamed & (F.col("n") > 0)), value, shares, [group])
    if not sizes.where(unnamed & (F.col("n") > 0)).isEmpty():
        found = found.unionByName(quantiles(rows.where(unnamed), value, shares).withColumn(group, F.lit(None).cast(dict(rows.dtypes)[group])))
    own = found.drop("n").withColumnRenamed(group, "of__")
    return sizes.select(group, "n").join(own, F.col(group).eqNullSafe(F.col("of__")), "left").drop("of__")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho): correlation of average ranks."""
    both = average_ranks(average_ranks(rows.select(a, b).dropna(), a, "ra"), b, "rb")
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))


def wilcoxon(rows: DataFrame, difference: str) -> DataFrame:
    """(n, wins, losses, w, z): signed rank statistic of non-zero differences and its normal approximation."""
    used = rows.where(F.col(difference) != 0).select(F.col(difference).alias("d"), F.abs(difference).alias("a"))
    ranked = average_ranks(used, "a", "r")
    sums = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") < 0).alias("wins"), F.count_if(F.col("d") > 0).alias("losses"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("down"),
    )
    n = F.col("n")
    w = F.least("up", "down")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return sums.select("n", "wins", "losses", w.alias("w"), z.alias("z"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, po, pe, kappa): Cohen's agreement of two labels; kappa is null where chance alone agrees fully."""
    cells = rows.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "a").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    both = total.join(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("po"), (F.col("c") / (F.col("n") * F.col("n"))).alias("pe"))
    return both.select("n", F.round("po", 3).alias("po"), F.round("pe", 3).alias("pe"), F.round((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0)), 3).alias("kappa"))


def alpha(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n_items, alpha, d_o, d_e, categories): Krippendorff's nominal agreement of two coders; null without spread."""
    items = rows.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna()
    seen = items.agg(F.count(F.lit(1)).alias("n_items"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("d_o"))
    marginals = items.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    squares = marginals.agg(F.sum(F.col("c") * F.col("c")).alias("s"), F.count(F.lit(1)).alias("categories"))
    n = 2 * F.col("n_items")
    both = seen.join(F.broadcast(squares)).withColumn("d_e", (n * n - F.col("s")) / (n * (n - 1)))
    return both.select("n_items", F.round(1 - F.col("d_o") / F.nullif("d_e", F.lit(0.0)), 3).alias("alpha"), F.round("d_o", 4).alias("d_o"), F.round("d_e", 4).alias("d_e"), "categories")


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, 0 where undefined."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def histogram(rows: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """(group, bin, n) over equal bins of the whole range; the last bin is closed."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return rows.join(F.broadcast(ends)).groupBy(group, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def kaplan_meier(rows: DataFrame, time: str, event: str, z: float = 1.959963984540054) -> DataFrame:
    """(t, n_risk, n_event, survival, ci_lo, ci_hi) at t = 0 and each event time, with log-log intervals.

    Counts per distinct time come first; only these go through running sums of logarithms, dealt by ranges of time.
    """
    per = rows.groupBy(F.col(time).cast("double").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("d"))
    risk = running_totals(per, "t", {"n_risk": "n"}, descending=True).where("d > 0")
    some = F.col("d") < F.col("n_risk")
    terms = risk.select(
        "t", "n_risk", "d", F.when(some, F.log(1 - F.col("d") / F.col("n_risk"))).otherwise(0.0).alias("log_s"), F.when(some, 0).otherwise(1).alias("none_left"),
        F.when(some, F.col("d") / (F.col("n_risk") * (F.col("n_risk") - F.col("d")))).otherwise(0.0).alias("v"),
    )
    summed = running_totals(terms, "t", {"alive": "log_s", "dead": "none_left", "g": "v"})
    curve = summed.select("t", "n_risk", F.col("d").alias("n_event"), F.when(F.col("dead") > 0, 0.0).otherwise(F.exp("alive")).alias("survival"), "g")
    inside = (F.col("survival") > 0) & (F.col("survival") < 1) & (F.col("g") > 0)
    se = F.sqrt("g") / F.abs(F.log("survival"))
    x, y = F.pow("survival", F.exp(z * se)), F.pow("survival", F.exp(-z * se))
    curve = curve.select("t", "n_risk", "n_event", "survival", F.when(inside, F.least(x, y)).otherwise(F.col("survival")).alias("ci_lo"), F.when(inside, F.greatest(x, y)).otherwise(F.col("survival")).alias("ci_hi"))
    start = rows.agg(F.count(F.lit(1)).alias("n_risk")).select(F.lit(0.0).alias("t"), "n_risk", F.lit(0).cast("long").alias("n_event"), *[F.lit(1.0).alias(c) for c in ("survival", "ci_lo", "ci_hi")])
    return start.unionByName(curve)


def median_survival(curve: DataFrame) -> DataFrame:
    """(median): the first time with at most half surviving, null if there is none."""
    return curve.agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))


def logrank(rows: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(grp, observed, expected, variance) of each group over all event times with more than one at risk.

    A row at risk until t meets every event time up to t, so sums over event times and groups become running sums over
    times, looked up once for each group's own times.
    """
    per = rows.groupBy(F.col(time).cast("double").alias("t"), F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("ng"), F.sum(F.col(event).cast("long")).alias("dg"))
    times = running_totals(per.groupBy("t").agg(F.sum("ng").alias("n"), F.sum("dg").alias("d")), "t", {"nj": "n"}, descending=True)
    counts, nj, d = F.expr("d > 0 and nj > 1"), F.col("nj"), F.col("d")
    weight = F.when(counts, d * (nj - d) / (nj - 1) / (nj * nj)).otherwise(0.0)
    terms = times.select("t", counts.alias("counts"), F.when(counts, d / nj).otherwise(0.0).alias("h"), weight.alias("w"), (weight * nj).alias("wn"))
    sums = running_totals(terms, "t", {"hazard": "h", "weights": "w", "weighted": "wn"})
    own = running_totals(per, "t", {"nij": "ng"}, descending=True, within="grp").join(sums, "t")
    left = F.col("nij") - F.col("ng")
    squares = F.col("weights") * (F.col("nij") * F.col("nij") - left * left)
    return own.groupBy("grp").agg(
        F.coalesce(F.sum(F.when(F.col("counts"), F.col("dg"))), F.lit(0)).alias("observed"), F.sum(F.col("ng") * F.col("hazard")).alias("expected"),
        (F.sum(F.col("ng") * F.col("weighted")) - F.sum(squares)).alias("variance"),
    )


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: by its series below a + 1, by a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a  # Lentz's method
    c, d = 1e300, 1 / b
    h, i = d, 0
    while True:
        i += 1
        an, b = -i * (i - a), b + 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15 or i > 10_000:
            return scale * h


def chi_square_tail(chi2: float, df: int) -> float:
    """How likely a chi-square variable exceeds ``chi2``."""
    return upper_gamma(df / 2, chi2 / 2)


def logrank_sums(rows: DataFrame, time: str, event: str, group: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(groups, observed, expected, covariance) over all event times with more than one at risk.

    One row for each distinct time holds how many of each group are at risk from then on, by running totals; the covariance of
    every two groups is a sum over these rows.  Only the sums reach the driver, groups times groups of them.
    """
    known = rows.where(F.col(time).isNotNull() & F.col(group).isNotNull())
    groups = [r[0] for r in known.select(group).distinct().orderBy(group).collect()]
    if not groups:
        return groups, np.zeros(0), np.zeros(0), np.zeros((0, 0))
    k = range(len(groups))
    of = lambda i, x: F.sum(F.when(F.col(group) == F.lit(groups[i]), x).otherwise(0)).cast("double")
    happened = F.coalesce(F.col(event).cast("long"), F.lit(0))
    per = known.groupBy(F.col(time).cast("double").alias("t")).agg(*[of(i, F.lit(1)).alias(f"n{i}") for i in k], *[of(i, happened).alias(f"d{i}") for i in k])
    risk = running_totals(per, "t", {f"r{i}": f"n{i}" for i in k}, descending=True)
    n, d = (sum(F.col(f"{c}{i}") for i in k) for c in "rd")
    used = risk.withColumns({"n": n, "d": d}).where("d > 0 and n > 1")
    factor = F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1) / (F.col("n") * F.col("n"))
    cells = [F.sum(factor * ((F.col(f"r{i}") * F.col("n") if i == j else F.lit(0.0)) - F.col(f"r{i}") * F.col(f"r{j}"))).alias(f"v{i}_{j}") for i in k for j in k if i <= j]
    sums = used.agg(*[F.sum(f"d{i}").alias(f"o{i}") for i in k], *[F.sum(F.col(f"r{i}") * F.col("d") / F.col("n")).alias(f"e{i}") for i in k], *cells).first()
    value = lambda name: sums[name] or 0.0
    return groups, np.array([value(f"o{i}") for i in k]), np.array([value(f"e{i}") for i in k]), np.array([[value(f"v{min(i, j)}_{max(i, j)}") for j in k] for i in k])


def logrank_test(rows: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(groups, chi2, df, p): whether k groups survive alike; null with fewer than two groups.

    The last group's difference follows from the others', so it is left out; a singular covariance has a pseudo-inverse.
    """
    groups, observed, expected, covariance = logrank_sums(rows, time, event, group)
    chi2 = p = df = None
    if len(groups) > 1:
        z, df = (observed - expected)[:-1], len(groups) - 1
        chi2 = float(z @ np.linalg.pinv(covariance[:-1, :-1]) @ z)
        p = chi_square_tail(chi2, df)
    return rows.sparkSession.createDataFrame([(len(groups), chi2, df, p)], "groups int, chi2 double, df int, p double")


def logrank_pairs(rows: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(a, b, chi2, p) of every two groups by themselves, with the risk sets of the two alone."""
    rows = stored(rows.select(time, event, group), "spans")
    names = [r[0] for r in rows.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).collect()]
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            _, observed, expected, v = logrank_sums(rows.where(F.col(group).isin(a, b)), time, event, group)
            chi2 = float((observed[0] - expected[0]) ** 2 / v[0, 0]) if len(v) and v[0, 0] > 0 else None
            out.append((str(a), str(b), chi2, None if chi2 is None else chi_square_tail(chi2, 1)))
    return rows.sparkSession.createDataFrame(out, "a string, b string, chi2 double, p double")
