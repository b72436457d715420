"""Queries of errors and agreement over ``lineitem``, ``labels``, ``events`` and ``documents``.

A line's price is the truth, its quantity times the mean price per unit of its part's flag the prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import stats
from attestor.plans.common import rounded, table


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("p", F.col("l_quantity") * 1500 * (1 - F.col("l_discount")))


def fold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Errors over all lines."""
    return rounded(_predicted(spark, folder).agg(*stats.errors(F.col("l_extendedprice"), F.col("p"))), 4)


def per_group_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Errors by flag and status with subtotals."""
    r = _predicted(spark, folder).rollup("l_returnflag", "l_linestatus").agg(*stats.errors(F.col("l_extendedprice"), F.col("p")))
    return rounded(r, 4)


def top_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest errors."""
    r = _predicted(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.abs(F.col("l_extendedprice") - F.col("p")), 4).alias("error"))
    return r.orderBy(F.desc("error"), "l_orderkey", "l_linenumber", "l_partkey").limit(10)


def spearman(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of quantity and price."""
    return rounded(stats.spearman(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"))


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty bins of prices by flag."""
    return stats.histogram(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", 30)


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    """How often the price lies in a band around its prediction, by flag."""
    p = F.col("p")
    inside = F.col("l_extendedprice").between(p * 0.5, p * 1.5)
    return rounded(_predicted(spark, folder).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"), (F.count_if(inside) / F.count(F.lit(1))).alias("share")))


def repeat_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, sample deviation and number of repeats by two keys."""
    r = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linenumber")
    return rounded(r.agg(F.avg("l_tax").alias("mean"), F.stddev_samp("l_tax").alias("std"), F.count("l_tax").alias("n")))


def quantile_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Limits that leave half a per cent on each side."""
    return rounded(stats.quantiles(table(spark, folder, "lineitem"), "l_extendedprice", {"lo": 0.005, "hi": 0.995}).select("lo", "hi"), 3)


def paired_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Signed ranks of the parts' price differences between two flags."""
    r = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("r"))
    return rounded(stats.wilcoxon(r.select(F.round(F.col("a") - F.col("r"), 4).alias("d")).dropna(), "d"))


def kappa(spark: SparkSession, folder: str) -> DataFrame:
    """Cohen's agreement of quality and toxic as two annotators."""
    return stats.kappa(table(spark, folder, "labels"), "quality", "toxic")


def alpha(spark: SparkSession, folder: str) -> DataFrame:
    """Krippendorff's agreement of the same."""
    return stats.alpha(table(spark, folder, "labels"), "quality", "toxic")


def codings(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of two coders over all documents, with a mark where one has none."""
    d = table(spark, folder, "documents").where("lang <> 'en'").select("doc_id", F.col("lang").alias("b"))
    both = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("a")).join(d, "doc_id", "full_outer")
    return both.groupBy(F.coalesce("a", F.lit("∅")).alias("a"), F.coalesce("b", F.lit("∅")).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def prf(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of quality as a prediction of clean documents by source, and overall."""
    l = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    count = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    r = l.rollup("source").agg(count(1, 0).alias("tp"), count(1, 1).alias("fp"), count(0, 0).alias("fn"))
    return rounded(r.select("source", "tp", "fp", "fn", *stats.scores(F.col("tp"), F.col("fp"), F.col("fn"))))


def agreement(spark: SparkSession, folder: str) -> DataFrame:
    """F1 and Jaccard of two sets from their counts."""
    r = table(spark, folder, "labels").agg(F.sum("quality").alias("a"), F.sum("toxic").alias("b"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("m"))
    union = F.col("a") + F.col("b") - F.col("m")
    return r.select(F.col("m").alias("matched"), F.round(2 * F.col("m") / F.nullif(F.col("a") + F.col("b"), F.lit(0)), 3).alias("f1"), F.round(F.col("m") / F.nullif(union, F.lit(0)), 3).alias("jaccard"))


def jaccard_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Jaccard of the user sets of every two event types, by counting shared users."""
    e = table(spark, folder, "events").where("value > 100").select("event_type", "user_id").distinct()
    size = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    both = e.alias("a").join(e.alias("b"), (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_type") < F.col("b.event_type")))
    shared = both.groupBy(F.col("a.event_type").alias("a"), F.col("b.event_type").alias("b")).agg(F.count(F.lit(1)).alias("m"))
    sized = shared.join(size.select(F.col("event_type").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("event_type").alias("b"), F.col("n").alias("nb")), "b")
    return rounded(sized.select("a", "b", (F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))).alias("jaccard")))


def ape(spark: SparkSession, folder: str) -> DataFrame:
    """Absolute percentage errors by line number: mean, worst and the share above a half."""
    e = F.abs(F.col("l_extendedprice") - F.col("p")) / F.abs("l_extendedprice") * 100
    return rounded(_predicted(spark, folder).groupBy("l_linenumber").agg(F.avg(e).alias("mean"), F.max(e).alias("worst"), (F.count_if(e > 50) / F.count(F.lit(1))).alias("over")), 4)


QUERIES = {f.__name__: f for f in (
    fold_metrics, per_group_metrics, top_errors, spearman, histogram, calibration, repeat_stats, quantile_limits, paired_wins, kappa, alpha, codings, prf, agreement,
    jaccard_runs, ape,
)}
_P = "l_quantity * 1500 * (1 - l_discount)"
_ERR = f"round(sqrt(avg(pow(l_extendedprice - {_P}, 2))), 4) AS rmse, round(avg(abs(l_extendedprice - {_P}) / abs(l_extendedprice)) * 100, 4) AS mape, count(*) AS n"
_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
_PR = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6)"
ORACLE = {
    "fold_metrics": f"SELECT {_ERR} FROM lineitem",
    "per_group_metrics": f"SELECT l_returnflag, l_linestatus, {_ERR} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "top_errors": f"SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_extendedprice - {_P}), 4) AS error FROM lineitem ORDER BY error DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10",
    "spearman": f"SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT {_RANK.format(c='l_quantity')} AS a, {_RANK.format(c='l_extendedprice')} AS b FROM lineitem)",
    "histogram": """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
        SELECT l_returnflag, least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2""",
    "calibration": f"""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_extendedprice BETWEEN {_P} * 0.5 AND {_P} * 1.5) AS inside,
        round(count(*) FILTER (l_extendedprice BETWEEN {_P} * 0.5 AND {_P} * 1.5) / count(*), 6) AS share FROM lineitem GROUP BY 1""",
    "repeat_stats": "SELECT l_returnflag, l_linenumber, round(avg(l_tax), 6) AS mean, round(stddev_samp(l_tax), 6) AS std, count(l_tax) AS n FROM lineitem GROUP BY 1, 2",
    "quantile_limits": "SELECT round(quantile_cont(l_extendedprice, 0.005), 3) AS lo, round(quantile_cont(l_extendedprice, 0.995), 3) AS hi FROM lineitem",
    "paired_wins": f"""WITH d AS (SELECT round(avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'R'), 4) AS d FROM lineitem GROUP BY l_partkey),
        u AS (SELECT d, {_RANK.format(c="abs(d)")} AS r FROM d WHERE d <> 0),
        s AS (SELECT count(*) AS n, count(*) FILTER (d < 0) AS wins, count(*) FILTER (d > 0) AS losses, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down FROM u)
        SELECT n, wins, losses, least(up, down)::DOUBLE AS w, round((least(up, down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s""",
    "kappa": """WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) * avg(toxic) + avg(1 - quality) * avg(1 - toxic) AS pe FROM labels)
        SELECT n, round(po, 3) AS po, round(pe, 3) AS pe, round((po - pe) / nullif(1 - pe, 0), 3) AS kappa FROM s""",
    "alpha": """WITH s AS (SELECT count(*) AS n, avg((quality <> toxic)::INT) AS d_o FROM labels), m AS (SELECT v, count(*) AS c FROM (SELECT quality AS v FROM labels UNION ALL SELECT toxic FROM labels) GROUP BY v),
        q AS (SELECT sum(c * c)::DOUBLE AS s2, count(*) AS categories FROM m), e AS (SELECT n, d_o, (4.0::DOUBLE * n * n - s2) / (2.0::DOUBLE * n * (2 * n - 1)) AS d_e, categories FROM s, q)
        SELECT n AS n_items, round(1 - d_o / nullif(d_e, 0), 3) AS alpha, round(d_o, 4) AS d_o, round(d_e, 4) AS d_e, categories FROM e""",
    "codings": """SELECT coalesce(quality::VARCHAR, '∅') AS a, coalesce(lang, '∅') AS b, count(*) AS n FROM labels l FULL JOIN (SELECT * FROM documents WHERE lang <> 'en') d ON l.doc_id = d.doc_id GROUP BY 1, 2""",
    "prf": f"""WITH c AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn
        FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)) SELECT source, tp, fp, fn, {_PR} AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "agreement": """WITH c AS (SELECT sum(quality) AS a, sum(toxic) AS b, count(*) FILTER (quality = 1 AND toxic = 1) AS m FROM labels)
        SELECT m AS matched, round(2 * m / nullif(a + b, 0), 3) AS f1, round(m / nullif(a + b - m, 0), 3) AS jaccard FROM c""",
    "jaccard_runs": """WITH e AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 100), n AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1),
        s AS (SELECT x.event_type AS a, y.event_type AS b, count(*) AS m FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY 1, 2)
        SELECT a, b, round(m / (p.n + q.n - m), 6) AS jaccard FROM s JOIN n p ON p.event_type = a JOIN n q ON q.event_type = b""",
    "ape": f"""WITH e AS (SELECT l_linenumber, abs(l_extendedprice - {_P}) / abs(l_extendedprice) * 100 AS e FROM lineitem)
        SELECT l_linenumber, round(avg(e), 4) AS mean, round(max(e), 4) AS worst, round(count(*) FILTER (e > 50) / count(*), 4) AS over FROM e GROUP BY 1""",
}
