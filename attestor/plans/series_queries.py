"""Queries over time series: ``events`` as cells (users) with cycles in order of time, ``orders`` as life spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.operators import cells, series, stats
from attestor.plans.common import rounded, seconds, table
from attestor.storage import stored


def _cycles(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, cycle, cap, event_type): the n-th event of a user is the n-th cycle."""
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, folder, "events").select(F.col("user_id").alias("cell"), F.row_number().over(w).cast("long").alias("cycle"), F.col("value").alias("cap"), "event_type")


_CYC = "c AS (SELECT user_id AS cell, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS cycle, value AS cap, event_type FROM events)"


def _nominal():
    return F.when(F.col("cell") % 2 == 0, 60.0)


def conform_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """The tidy table in contract order and types, absent metadata as nulls, then counted by study."""
    from attestor import schemas

    raw = _cycles(spark, folder).select(
        F.concat(F.lit("u"), "cell").alias("cell_id"), F.lit("events").alias("study"), F.col("cycle").alias("cycle_index"), F.col("cap").alias("discharge_capacity_ah"), "event_type"
    )
    t = schemas.conform(raw)
    return rounded(t.groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("cells"), F.count("chemistry").alias("with_chemistry"), F.avg("discharge_capacity_ah").alias("mean_capacity")))


def life_table(spark: SparkSession, folder: str) -> DataFrame:
    """Life of every cell under both definitions with its flags."""
    out = series.lives(_cycles(spark, folder), "cell", "cycle", "cap", F.max(_nominal()))
    return rounded(out.select("cell", "n_cycles", "init", "final", "basis", "life_init", "life_nominal", "life", "flags", "anomalous"))


def qc_flags(spark: SparkSession, folder: str) -> DataFrame:
    """How often each flag list occurs."""
    out = series.lives(_cycles(spark, folder), "cell", "cycle", "cap", F.max(_nominal()))
    return out.groupBy("flags").agg(F.count(F.lit(1)).alias("n"), F.count_if("anomalous").alias("anomalous"))


def life_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Life under other windows, tolerances and interpolation."""
    cycles, parts = _cycles(spark, folder), []
    for name, reach, tolerance, nearest in (("w1", 0, 0.01, False), ("w3", 1, 0.01, False), ("w7", 3, 0.01, False), ("strict", 2, None, False), ("nearest", 2, 0.02, True)):
        v = series.lives(cycles, "cell", "cycle", "cap", None, reach, tolerance, nearest)
        parts.append(v.select(F.lit(name).alias("variant"), "life"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count("life").alias("reached"), F.avg("life").alias("mean_life")))


def early_features(spark: SparkSession, folder: str) -> DataFrame:
    """Slope and end values of cycles 2 to 50."""
    return rounded(series.early_features(_cycles(spark, folder), "cell", "cycle", "cap", 2, 50).withColumn("slope", F.round("slope", 9)), slope=9)


def nearest_value(spark: SparkSession, folder: str) -> DataFrame:
    """The value at cycle 70 or the nearest there is."""
    return rounded(series.at_cycle(_cycles(spark, folder), "cell", "cycle", "cap", 70))


def curve_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Spread and depth of the difference of the two halves of each vector, as of an early and a late curve."""
    e = table(spark, folder, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    both = e.select("vec_id", F.slice("v", 1, 32).alias("early"), F.slice("v", 33, 32).alias("late"))
    return rounded(series.curve_difference(both, "early", "late").select("vec_id", "var_difference", "min_difference"))


def gap_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of events without a gap of over a day."""
    runs = series.gap_runs(table(spark, folder, "events"), "user_id", seconds("ts"), 86400.0)
    return rounded(runs.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.sum("value").alias("total")))


def longest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of every user."""
    return series.longest_run(series.gap_runs(table(spark, folder, "events"), "user_id", seconds("ts"), 86400.0), "user_id")


def qv_interp(spark: SparkSession, folder: str) -> DataFrame:
    """Values of every user interpolated at eleven cycles, null outside what was seen."""
    c = _cycles(spark, folder).select("cell", F.col("cycle").cast("double").alias("x"), F.col("cap").alias("y"))
    grid = c.select("cell").distinct().select("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i * 7.5)).alias("g"))
    return rounded(series.interpolated(c, "cell", "x", "y", grid, clamp=False))


def interp_clamped(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the end values held."""
    c = _cycles(spark, folder).select("cell", F.col("cycle").cast("double").alias("x"), F.col("cap").alias("y"))
    grid = c.select("cell").distinct().select("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i * 7.5)).alias("g"))
    return rounded(series.interpolated(c, "cell", "x", "y", grid))


def continuation_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Users 1 to 5 continued by 6 to 10, counted."""
    c = _cycles(spark, folder).where("cycle <> 1")
    links = spark.createDataFrame([(i, i + 5) for i in range(1, 6)], "entity long, next long")
    out = series.continued(c, "cell", "cycle", links)
    return rounded(out.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("cycle").alias("last"), F.sum("cap").alias("total")))


def dense_pair(spark: SparkSession, folder: str) -> DataFrame:
    """The first day of a user with over two events and the first such day a week later, else the last."""
    day = F.floor(seconds("ts") / 86400).cast("long")
    dense = table(spark, folder, "events").groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    first = dense.withColumn("d0", F.min("day").over(Window.partitionBy("user_id")))
    out = first.groupBy("user_id").agg(F.min("day").alias("first_day"), F.coalesce(F.min(F.when(F.col("day") >= F.col("d0") + 7, F.col("day"))), F.max("day")).alias("second_day"), F.count(F.lit(1)).alias("days"))
    return out.where("days >= 2")


def discharge_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Per user and type of event: last less first value, null for a single one."""
    e = table(spark, folder, "events")
    used = F.when(F.count(F.lit(1)) >= 2, F.min_by("value", "ts") - F.max_by("value", "ts"))
    return rounded(e.groupBy("user_id", "event_type").agg(used.alias("discharged"), F.count(F.lit(1)).alias("n")))


def flag_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Unbroken runs of the same event type of a user with at least three events, as runs of ink on a row."""
    c = _cycles(spark, folder)
    w = Window.partitionBy("cell", "event_type").orderBy("cycle")
    runs = c.withColumn("island", F.col("cycle") - F.row_number().over(w)).groupBy("cell", "event_type", "island").agg(F.count(F.lit(1)).alias("n"), F.min("cycle").alias("start"))
    return runs.where("n >= 3").select("cell", "event_type", "start", "n")


def survival_table(spark: SparkSession, folder: str) -> DataFrame:
    """Time and event per cell: end of life, or the last cycle if there is none."""
    out = series.lives(_cycles(spark, folder), "cell", "cycle", "cap")
    return rounded(out.select("cell", F.coalesce("life", "last_cycle").alias("time"), F.col("life").isNotNull().cast("int").alias("event")))


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """(time, event, grp): days from order to first shipment; an event if the order is finished."""
    first = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    o = table(spark, folder, "orders").join(first, "o_orderkey")
    days = F.abs(F.datediff("ship", "o_orderdate")) % 200 + 1
    return o.select(days.cast("double").alias("time"), (F.col("o_orderstatus") == "F").cast("int").alias("event"), F.col("o_orderpriority").alias("grp"))


_SPANS = """s AS (SELECT (abs(date_diff('day', o.o_orderdate::DATE, l.ship::DATE)) % 200 + 1)::DOUBLE AS time, (o.o_orderstatus = 'F')::INT AS event, o.o_orderpriority AS grp
    FROM orders o JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey)"""


def km_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Kaplan-Meier curve of all spans."""
    return rounded(stats.kaplan_meier(_spans(spark, folder), "time", "event"))


def km_median(spark: SparkSession, folder: str) -> DataFrame:
    """Median survival."""
    return stats.median_survival(stats.kaplan_meier(_spans(spark, folder), "time", "event"))


def logrank_oe(spark: SparkSession, folder: str) -> DataFrame:
    """Observed and expected events of each priority."""
    return rounded(stats.logrank(_spans(spark, folder), "time", "event", "grp"), 5)


def logrank_test(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the spans of all priorities end alike: chi-square, degrees of freedom and probability."""
    return rounded(stats.logrank_test(_spans(spark, folder), "time", "event", "grp"))


def logrank_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every two priorities by themselves."""
    return rounded(stats.logrank_pairs(_spans(spark, folder), "time", "event", "grp").select("a", "b", "chi2"), 5)


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as steps, sixteen a cycle, of which the first eleven to thirteen discharge."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, folder, "events").withColumn("n", n).withColumn("pos", F.col("n") % 16)
    out = F.col("pos") < 11 + F.col("user_id") % 3
    status = F.when(out & ((F.col("user_id") % 4 != 0) | (F.col("pos") != 3)), "CC Discharge").when(out, "rest").otherwise("CC Charge")
    return e.select(
        F.col("user_id").alias("cell"), (F.floor(F.col("n") / 16) + 1).cast("int").alias("cycle"), F.col("pos").alias("seq"), status.alias("status"),
        (3000 - 100 * F.col("pos") - F.col("event_id") % 10).cast("double").alias("capacity"), (4.2 - 0.05 * F.col("pos") - F.col("event_id") % 100 / 10000).alias("voltage"), seconds("ts").alias("time"),
    )


_STEPS = """ev AS (SELECT user_id AS cell, event_id, epoch_us(ts) / 1e6 AS time, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
    sp AS (SELECT cell, (n // 16 + 1)::INT AS cycle, n % 16 AS seq, CASE WHEN n % 16 < 11 + cell % 3 THEN CASE WHEN cell % 4 <> 0 OR n % 16 <> 3 THEN 'd' ELSE 'r' END ELSE 'c' END AS status,
        (3000 - 100 * (n % 16) - event_id % 10)::DOUBLE AS capacity, 4.2::DOUBLE - 0.05::DOUBLE * (n % 16) - event_id % 100 / 10000 AS voltage, time FROM ev),
    td0 AS (SELECT cell, cycle, CASE WHEN count(*) FILTER (status = 'd') >= 2 THEN (arg_min(capacity, seq) FILTER (status = 'd') - arg_max(capacity, seq) FILTER (status = 'd')) / 1000 END AS cap,
        CASE WHEN count(*) FILTER (status = 'c') >= 2 THEN (arg_max(time, seq) FILTER (status = 'c') - arg_min(time, seq) FILTER (status = 'c')) / 60 END AS ct FROM sp GROUP BY 1, 2),
    td AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY cycle) AS nth FROM td0) WHERE (cell % 10 <> 0 OR nth > 1) AND cap > 0)"""


def cell_features(spark: SparkSession, folder: str) -> DataFrame:
    """The seven early features of every cell from its raw steps; every tenth cell starts with its second cycle."""
    steps = _steps(spark, folder)
    skipped = steps.where("cell % 10 = 0").select("cell").distinct().withColumn("n", F.lit(1))
    return rounded(cells.processed(steps, 2, 3, 1, 4, skipped, grid=40)[1])


def cell_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """The tidy cycles of every cell from its raw steps."""
    return rounded(cells.tidy_cycles(_steps(spark, folder)))


def surrogate_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of each cell over its own first dense cycle and the first one two cycles later."""
    steps = _steps(spark, folder)
    return rounded(cells.surrogate_features(steps, cells.tidy_cycles(steps), 10, 2, grid=40))


def _tidy(spark: SparkSession, folder: str) -> DataFrame:
    return stored(cells.tidy_cycles(_steps(spark, folder)).select("cell", "cycle", F.col("discharge_capacity_ah").alias("cap")), "tidy")


def _instances(tidy: DataFrame) -> DataFrame:
    lives = stored(series.lives(tidy, "cell", "cycle", "cap").select("cell", "life", "init", "last_cycle", "anomalous"), "lives")
    early = series.early_features(tidy, "cell", "cycle", "cap", 2, 50).select("cell", "slope", "at_lo", "at_hi")
    described = lives.select("cell", F.when(F.col("cell") % 7 != 0, F.concat((F.col("cell") % 5).cast("string"), F.lit("C(80%)-4C"))).alias("policy"))
    return cells.instances(lives, early, described, "events")


def study_instances(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each usable cell: life or censoring, features, policy and its group."""
    return rounded(_instances(_tidy(spark, folder)))


def study_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What the cells' first capacities say about a nominal one of 1.1."""
    tidy = _tidy(spark, folder)
    return rounded(cells.evidence(_instances(tidy), tidy, 1.1, 0.09))


def censoring_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, events and median time of each priority."""
    s = _spans(spark, folder)
    middle = stats.quantiles(s, "time", {"median_time": 0.5}, "grp").select("grp", "median_time")
    return rounded(s.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events")).join(middle, "grp", "left"))


QUERIES = {f.__name__: f for f in (
    conform_cycles, life_table, qc_flags, life_variants, early_features, nearest_value, curve_difference, gap_sessions, longest_run, qv_interp, interp_clamped,
    continuation_merge, dense_pair, discharge_steps, flag_islands, survival_table, km_curve, km_median, logrank_oe, logrank_test, logrank_pairs, censoring_by_group, cell_features, cell_cycles, surrogate_features, study_instances, study_evidence,
)}


def _life(reach: int = 2, tolerance: str = "0.01", nearest: bool = False, nominal: bool = True) -> str:
    """CTEs up to ``lf``: one row for each cell."""
    between = "CASE WHEN abs(c0 - thr) <= abs(c1 - thr) THEN n0 ELSE n1 END" if nearest else "n0 + (c0 - thr) / (c0 - c1) * (n1 - n0)"
    ends = lambda b: f"CASE WHEN final <= 0.8 * {b} * (1 + {tolerance}) THEN last_cycle END" if tolerance else "NULL::DOUBLE"
    cross = lambda t: f"""SELECT cell, arg_min(CASE WHEN n0 IS NULL OR c0 = c1 THEN n1 ELSE {between} END, n1) AS x FROM
        (SELECT cell, cycle::DOUBLE AS n1, smooth AS c1, {t} AS thr, lag(cycle::DOUBLE) OVER w AS n0, lag(smooth) OVER w AS c0 FROM cv WINDOW w AS (PARTITION BY cell ORDER BY cycle))
        WHERE c1 <= thr GROUP BY cell"""  # noqa: E731
    nom = "CASE WHEN cell % 2 = 0 THEN 60.0::DOUBLE END" if nominal else "NULL::DOUBLE"
    return f"""{_CYC}, st AS (SELECT *, cap - lag(cap) OVER (PARTITION BY cell ORDER BY cycle) AS step FROM c),
    fa AS (SELECT cell, count(*) AS n_cycles, arg_max(cap, cycle) AS final, max(cap) AS top, min(step) AS drop_, max(cycle)::DOUBLE AS last_cycle, {nom} AS nominal FROM st GROUP BY cell),
    ini AS (SELECT cell, quantile_cont(cap, 0.5) AS init FROM c WHERE cycle <= 5 GROUP BY cell),
    sm AS (SELECT *, quantile_cont(cap, 0.5) OVER (PARTITION BY cell ORDER BY cycle ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS smooth FROM c),
    cv AS (SELECT sm.*, 0.8 * ini.init AS thr_i, 0.8 * fa.nominal AS thr_n FROM sm JOIN ini USING (cell) JOIN fa USING (cell)),
    xi AS ({cross("thr_i")}), xn AS ({cross("thr_n")}),
    lv AS (SELECT fa.*, ini.init, coalesce(xi.x, {ends("init")}) AS life_init, CASE WHEN nominal > 0 THEN coalesce(xn.x, {ends("nominal")}) END AS life_nominal
           FROM fa JOIN ini USING (cell) LEFT JOIN xi USING (cell) LEFT JOIN xn USING (cell)),
    lb AS (SELECT *, CASE WHEN nominal > 0 THEN life_nominal ELSE life_init END AS life, CASE WHEN nominal > 0 THEN 'nominal' ELSE 'initial_capacity' END AS basis FROM lv),
    lf AS (SELECT *, concat_ws(',', CASE WHEN n_cycles < 50 THEN 'short_series' END, CASE WHEN nominal > 0 AND top > 1.2 * nominal THEN 'capacity_gt_nominal' END,
               CASE WHEN nominal > 0 AND init < 0.5 * nominal THEN 'low_initial_capacity' END, CASE WHEN n_cycles > 2 AND init > 0 AND drop_ < -0.15 * init THEN 'capacity_spike_down' END,
               CASE WHEN life IS NULL THEN 'no_eol_reached' END) AS flags FROM lb)"""


def _curves(cycles: str, only: str = "") -> str:
    """CTE cv: the points of the curves of some cycles, with the next point by voltage."""
    return f"""cv0 AS (SELECT cell, cycle, voltage AS v, (first_value(capacity) OVER (PARTITION BY cell, cycle ORDER BY seq) - capacity) / 1000 AS q, count(*) OVER (PARTITION BY cell, cycle) AS k FROM sp {only} WHERE status = 'd' AND cycle IN ({cycles})),
    cv AS (SELECT cell, cycle, v, q, lead(v) OVER w AS v2, lead(q) OVER w AS q2 FROM cv0 WHERE k >= 10 WINDOW w AS (PARTITION BY cell, cycle ORDER BY v))"""


_DQ = """en AS (SELECT pr.cell, c1, c2, greatest(min(v) FILTER (cycle = c1), min(v) FILTER (cycle = c2)) + 0.01::DOUBLE AS lo, least(max(v) FILTER (cycle = c1), max(v) FILTER (cycle = c2)) - 0.01::DOUBLE AS hi FROM pr JOIN cv ON cv.cell = pr.cell GROUP BY 1, 2, 3),
    gd AS (SELECT *, lo + (hi - lo) * i / 39 AS g, i FROM en, range(40) t(i) WHERE lo IS NOT NULL AND hi IS NOT NULL),
    ip AS (SELECT gd.cell, i, sum(CASE WHEN cycle = c2 THEN 1 ELSE -1 END * (q + (g - v) / (v2 - v) * (q2 - q))) AS d, count(*) AS k FROM gd JOIN cv ON cv.cell = gd.cell AND cv.cycle IN (c1, c2) AND g >= v AND g < v2 GROUP BY 1, 2),
    dq AS (SELECT cell, var_pop(d) AS v, min(d) AS l FROM ip WHERE k = 2 GROUP BY 1)"""
_ANOMALOUS = "len(list_intersect(string_split(flags, ','), ['non_finite_capacity', 'capacity_gt_nominal', 'low_initial_capacity', 'capacity_spike_down'])) > 0"
_RUNS = """g AS (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) > 86400 AS new FROM events),
    r AS (SELECT *, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS run FROM g)"""
_INTERP = f"""{_CYC}, k AS (SELECT cell, cycle::DOUBLE AS x0, cap AS y0, lead(cycle::DOUBLE) OVER w AS x1, lead(cap) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY cell ORDER BY cycle)),
    ends AS (SELECT cell, min(x0) AS lo, max(x0) AS hi, arg_min(y0, x0) AS ylo, arg_max(y0, x0) AS yhi FROM k GROUP BY cell),
    gr AS (SELECT cell, i * 7.5::DOUBLE AS g, lo, hi, ylo, yhi FROM ends, range(11) t(i)),
    ip AS (SELECT gr.*, k.y0 + (g - k.x0) / (k.x1 - k.x0) * (k.y1 - k.y0) AS mid FROM gr LEFT JOIN k ON k.cell = gr.cell AND g >= k.x0 AND g < k.x1)"""
_KM = f"""{_SPANS}, per AS (SELECT time AS t, count(*) AS n, sum(event)::BIGINT AS d FROM s GROUP BY 1),
    rk AS (SELECT t, d, CAST(sum(n) OVER (ORDER BY t DESC) AS BIGINT) AS n_risk FROM per),
    cu AS (SELECT t, n_risk, d, CASE WHEN max((d = n_risk)::INT) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < n_risk THEN ln(1 - d / n_risk) END) OVER w) END AS survival,
        sum(CASE WHEN d < n_risk THEN d / (n_risk * (n_risk - d)) ELSE 0 END) OVER w AS g FROM rk WHERE d > 0 WINDOW w AS (ORDER BY t)),
    ci AS (SELECT *, pow(survival, exp(1.959963984540054 * sqrt(g) / abs(ln(survival)))) AS a, pow(survival, exp(-1.959963984540054 * sqrt(g) / abs(ln(survival)))) AS b FROM cu WHERE survival > 0 AND survival < 1 AND g > 0),
    km AS (SELECT 0.0::DOUBLE AS t, count(*) AS n_risk, 0::BIGINT AS n_event, 1.0::DOUBLE AS survival, 1.0::DOUBLE AS ci_lo, 1.0::DOUBLE AS ci_hi FROM s
           UNION ALL SELECT cu.t, cu.n_risk, cu.d, cu.survival, coalesce(least(a, b), cu.survival), coalesce(greatest(a, b), cu.survival) FROM cu LEFT JOIN ci ON ci.t = cu.t)"""
_INSTANCES = f"""{_life(nominal=False).replace(_CYC, _STEPS + ", c AS (SELECT cell, cycle, cap FROM td0 WHERE cap > 0)")},
    e AS (SELECT cell, regr_slope(cap, cycle) FILTER (cycle BETWEEN 2 AND 50) AS slope, arg_min(cap, abs(cycle - 2) * 1000 + cycle) FILTER (cycle BETWEEN 2 AND 50) AS at_lo,
        arg_min(cap, abs(cycle - 50) * 1000 + cycle) FILTER (cycle BETWEEN 2 AND 50) AS at_hi FROM c GROUP BY 1),
    d AS (SELECT cell, CASE WHEN cell % 7 <> 0 THEN (cell % 5) || 'C(80%)-4C' END AS policy FROM lf),
    ins AS (SELECT 'events_' || cell AS instance_id, 'events' AS study, cell, policy, CASE WHEN policy IS NOT NULL THEN 'pg00' || (cell % 5) END AS policy_group, round(coalesce(life, last_cycle), 6) AS cycles, life IS NULL AS censored,
        round(init, 6) AS initial_capacity_ah, round(slope, 6) AS slope, round(at_lo, 6) AS at_lo, round(at_hi, 6) AS at_hi FROM lf JOIN d USING (cell) LEFT JOIN e USING (cell) WHERE NOT ({_ANOMALOUS}))"""
ORACLE = {
    "conform_cycles": f"WITH {_CYC} SELECT 'events' AS study, count(*) AS n, count(DISTINCT cell) AS cells, 0::BIGINT AS with_chemistry, round(avg(cap), 6) AS mean_capacity FROM c",
    "life_table": f"""WITH {_life()} SELECT cell, n_cycles, round(init, 6) AS init, round(final, 6) AS final, basis, round(life_init, 6) AS life_init, round(life_nominal, 6) AS life_nominal,
        round(life, 6) AS life, flags, {_ANOMALOUS} AS anomalous FROM lf""",
    "qc_flags": f"WITH {_life()} SELECT flags, count(*) AS n, count(*) FILTER ({_ANOMALOUS}) AS anomalous FROM lf GROUP BY flags",
    "life_variants": " UNION ALL ".join(
        f"SELECT '{name}' AS variant, count(*) AS n, count(life) AS reached, round(avg(life), 6) AS mean_life FROM (WITH {_life(reach, tol, near, False)} SELECT life FROM lf)"
        for name, reach, tol, near in (("w1", 0, "0.01", False), ("w3", 1, "0.01", False), ("w7", 3, "0.01", False), ("strict", 2, "", False), ("nearest", 2, "0.02", True))
    ),
    "early_features": f"""WITH {_CYC}, u AS (SELECT * FROM c WHERE cycle BETWEEN 2 AND 50)
        SELECT cell, round(regr_slope(cap, cycle), 9) AS slope, round(arg_min(cap, abs(cycle - 2) * 1000 + cycle), 6) AS at_lo, round(arg_min(cap, abs(cycle - 50) * 1000 + cycle), 6) AS at_hi, count(*) AS n,
               round(arg_min(cap, abs(cycle - 50) * 1000 + cycle) / nullif(arg_min(cap, abs(cycle - 2) * 1000 + cycle), 0), 6) AS ratio FROM u GROUP BY cell""",
    "nearest_value": f"WITH {_CYC} SELECT cell, round(arg_min(cap, abs(cycle - 70) * 100000 + cycle), 6) AS at_n FROM c GROUP BY cell",
    "curve_difference": """WITH d AS (SELECT vec_id, i, embedding[i + 32]::DOUBLE - embedding[i]::DOUBLE AS x FROM embeddings, range(1, 33) t(i))
        SELECT vec_id, round(log10(var_pop(x)), 6) AS var_difference, round(log10(abs(min(x))), 6) AS min_difference FROM d GROUP BY vec_id""",
    "gap_sessions": f"WITH {_RUNS} SELECT user_id, run, count(*) AS n, min(ts) AS first_ts, round(sum(value), 6) AS total FROM r GROUP BY 1, 2",
    "longest_run": f"""WITH {_RUNS}, n AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY 1, 2)
        SELECT user_id, run, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, run) AS k FROM n) WHERE k = 1""",
    "qv_interp": f"WITH {_INTERP} SELECT cell, g, round(CASE WHEN g < lo OR g > hi THEN NULL WHEN g = hi THEN yhi ELSE mid END, 6) AS y FROM ip",
    "interp_clamped": f"WITH {_INTERP} SELECT cell, g, round(CASE WHEN g < lo THEN ylo WHEN g >= hi THEN yhi ELSE mid END, 6) AS y FROM ip",
    "continuation_merge": f"""WITH {_CYC}, k AS (SELECT * FROM c WHERE cycle <> 1), n AS (SELECT cell, count(*) AS n FROM k GROUP BY cell),
        al AS (SELECT cell, cycle, cap, 0 AS late FROM k WHERE cell NOT BETWEEN 6 AND 10 OR cell - 5 NOT IN (SELECT cell FROM n)
               UNION ALL SELECT k.cell - 5, k.cycle + n.n, k.cap, 1 FROM k JOIN n ON n.cell = k.cell - 5 WHERE k.cell BETWEEN 6 AND 10),
        f AS (SELECT *, row_number() OVER (PARTITION BY cell, cycle ORDER BY late) AS r FROM al)
        SELECT cell, count(*) AS n, max(cycle) AS last, round(sum(cap), 6) AS total FROM f WHERE r = 1 GROUP BY cell""",
    "dense_pair": """WITH d AS (SELECT user_id, floor(epoch_us(ts) / 1e6 / 86400)::BIGINT AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2),
        f AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS d0 FROM d)
        SELECT user_id, min(day) AS first_day, coalesce(min(day) FILTER (day >= d0 + 7), max(day)) AS second_day, count(*) AS days FROM f GROUP BY user_id HAVING count(*) >= 2""",
    "discharge_steps": "SELECT user_id, event_type, round(CASE WHEN count(*) >= 2 THEN arg_min(value, ts) - arg_max(value, ts) END, 6) AS discharged, count(*) AS n FROM events GROUP BY 1, 2",
    "flag_islands": f"""WITH {_CYC}, i AS (SELECT *, cycle - row_number() OVER (PARTITION BY cell, event_type ORDER BY cycle) AS island FROM c)
        SELECT cell, event_type, min(cycle) AS start, count(*) AS n FROM i GROUP BY cell, event_type, island HAVING count(*) >= 3""",
    "survival_table": f"WITH {_life(nominal=False)} SELECT cell, round(coalesce(life, last_cycle), 6) AS time, (life IS NOT NULL)::INT AS event FROM lf",
    "km_curve": f"WITH {_KM} SELECT t, n_risk, n_event, round(survival, 6) AS survival, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM km",
    "km_median": f"WITH {_KM} SELECT min(t) FILTER (survival <= 0.5) AS median FROM km",
    "logrank_oe": f"""WITH {_SPANS}, ti AS (SELECT DISTINCT time AS t FROM s WHERE event = 1), g AS (SELECT DISTINCT grp FROM s),
        x AS (SELECT ti.t, g.grp, (SELECT count(*) FROM s WHERE time >= ti.t) AS nj, (SELECT count(*) FROM s WHERE time = ti.t AND event = 1) AS d,
                  (SELECT count(*) FROM s WHERE time >= ti.t AND s.grp = g.grp) AS nij, (SELECT count(*) FROM s WHERE time = ti.t AND event = 1 AND s.grp = g.grp) AS dg FROM ti, g)
        SELECT grp, sum(dg)::BIGINT AS observed, round(sum(nij * d / nj), 5) AS expected, round(sum(d * (nj - d) / (nj - 1) / (nj * nj) * (nij * nj - nij * nij)), 5) AS variance FROM x WHERE nj > 1 GROUP BY grp""",
    "cell_cycles": f"WITH {_STEPS} SELECT cell, cycle, round(cap, 6) AS discharge_capacity_ah, round(ct, 6) AS charge_min FROM td0 WHERE cap > 0",
    "cell_features": f"""WITH {_STEPS}, {_curves("2, 3", "JOIN td USING (cell, cycle)")}, pr AS (SELECT DISTINCT cell, 2 AS c1, 3 AS c2 FROM cv), {_DQ},
        f AS (SELECT cell, regr_slope(cap, cycle) FILTER (cycle BETWEEN 1 AND 4) AS slope, arg_min(cap, abs(cycle - 1) * 1000 + cycle) AS a, arg_min(cap, abs(cycle - 3) * 1000 + cycle) AS b, avg(ct) FILTER (cycle <= 4) AS m FROM td GROUP BY 1)
        SELECT f.cell, round(log10(greatest(v, 1e-12)), 6) AS var_dq, round(log10(greatest(abs(l), 1e-12)), 6) AS min_dq, round(slope, 6) AS slope, round(a, 6) AS capacity_early, round(b, 6) AS capacity_late, round(b / a, 6) AS cap_ratio,
               round(m, 6) AS mean_charge_min FROM f JOIN dq USING (cell)""",
    "study_instances": f"WITH {_INSTANCES} SELECT * FROM ins",
    "study_evidence": f"""WITH {_INSTANCES} SELECT count(*) AS cells_matched, min(initial_capacity_ah) AS least_initial, max(initial_capacity_ah) AS most_initial, count(*) FILTER (near) AS near_nominal,
        count(*) FILTER (initial_capacity_ah < 1.1) AS below_nominal, count(DISTINCT policy_group) AS groups, count(*) FILTER (censored) AS censored, (SELECT count(*) FROM c) AS rows_ingested,
        CASE WHEN count(*) FILTER (near) = count(*) THEN 'signature_consistent' ELSE 'asserted_from_publication' END AS identity_basis FROM (SELECT *, abs(initial_capacity_ah - 1.1::DOUBLE) <= 0.09::DOUBLE * 1.1::DOUBLE AS near FROM ins)""",
    "logrank_pairs": f"""WITH {_SPANS}, pr AS (SELECT x.grp AS a, y.grp AS b FROM (SELECT DISTINCT grp FROM s) x JOIN (SELECT DISTINCT grp FROM s) y ON x.grp < y.grp),
        ti AS (SELECT DISTINCT a, b, time AS t FROM pr JOIN s ON grp IN (a, b) WHERE event = 1),
        x AS (SELECT ti.*, (SELECT count(*) FROM s WHERE grp IN (a, b) AND time >= t) AS n, (SELECT count(*) FROM s WHERE grp IN (a, b) AND time = t AND event = 1) AS d,
                  (SELECT count(*) FROM s WHERE grp = a AND time >= t) AS na, (SELECT count(*) FROM s WHERE grp = a AND time = t AND event = 1) AS da FROM ti)
        SELECT a, b, round(pow(sum(da) - sum(na * d / n), 2) / sum(d * (n - d) / (n - 1) / (n * n) * (na * n - na * na)), 5) AS chi2 FROM x WHERE n > 1 GROUP BY a, b""",
    "censoring_by_group": f"WITH {_SPANS} SELECT grp, count(*) AS n, sum(event)::BIGINT AS events, round(quantile_cont(time, 0.5), 6) AS median_time FROM s GROUP BY grp",
}
