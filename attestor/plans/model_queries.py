"""Queries of models over ``embeddings`` and of sources read from text: rows only, or against SQL where it can tell."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import adaptation, artifacts, gate, graph, models, pinball
from attestor.plans.common import rounded, seconds, table
from attestor.plans.graph_queries import _FOLDS, VIEWS, _edges, _groups, _sql
from attestor.sources import archives, cycles, feeds
from attestor.storage import shared_root, stored

COLUMNS = [f"f{i}" for i in range(6)]


def _model_rows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("grp"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(6)])
    return e.withColumn("f5", F.when(F.col("vec_id") % 9 != 0, F.col("f5"))).withColumn("y", F.col("f0") * 2 + F.col("f1") * F.col("f2"))


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = models.with_indicators(_model_rows(spark, folder), COLUMNS)
    return models.cross_validated(models.grouped_folds(rows, "grp", 3), columns, "y", 3, rounds=10)


def gbt_cv(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold predictions with groups kept whole."""
    return _validated(spark, folder).select("vec_id", "fold", "y", "prediction")


def _covered(spark: SparkSession, folder: str) -> DataFrame:
    c = graph.loo_coverage(_edges(spark, folder), _groups(spark, folder)).select(F.col("id").alias("vec_id"), "coverage")
    return _validated(spark, folder).join(c, "vec_id")


def residual_band(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of residuals by bucket of coverage."""
    return models.residual_band(_covered(spark, folder), "y", "coverage")


def predict_with_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with bands, withheld where coverage is small."""
    p = _covered(spark, folder)
    return models.gated(p, "coverage", 1.7, models.residual_band(p, "y", "coverage")).select("vec_id", "coverage", "abstain", "low", "high", "value")


def _with_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Rows of every fold with their own columns and the neighbour features of both views from the fold's training rows."""
    rows = models.grouped_folds(_model_rows(spark, folder), "grp", 3).withColumnRenamed("vec_id", "id")
    edges = {v: _edges(spark, folder, v) for v in VIEWS}
    features, graph_columns = models.fold_features(edges, rows.select("id", "fold"), rows.select("id", "y"))
    return stored(features.join(rows.drop("fold"), "id"), "fold-rows"), [*COLUMNS, *graph_columns]


def graph_gbt_cv(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold predictions with neighbour features, those of each fold from its own training rows."""
    rows, columns = _with_graph(spark, folder)
    rows, columns = models.with_indicators(rows, columns)
    return models.fold_models(rows, columns, "y", rounds=10).select(F.col("id").alias("vec_id"), "fold", "y", "prediction")


def fold_graph_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbour features of every row with each of ten groups held out in turn."""
    groups = _groups(spark, folder)
    targets = groups.select("id", F.log10(F.col("id") + 100.0).alias("y"))
    rows, columns = models.fold_features({"behavior": _edges(spark, folder)}, groups.select("id", F.col("grp").alias("fold")), targets)
    return rounded(rows.select("fold", "id", "is_test", *columns))


def _spreads(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = _with_graph(spark, folder)
    x = F.array(*[F.col(c).cast("double") for c in columns])
    picked = rows.select(F.col("fold").alias("model"), "id", (~F.col("is_test")).alias("train"), "y", x.alias("x"))
    return pinball.spread(picked, "x", len(columns))


def quantile_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold 16th and 84th percentiles by boosted trees, and their distance as a sign of doubt."""
    return rounded(_spreads(spark, folder).select(F.col("id").alias("vec_id"), F.col("model").alias("fold"), "lo", "hi", "spread"))


def spread_gate(spark: SparkSession, folder: str) -> DataFrame:
    """A gate on coverage and the trees' spread together, thresholds from the other folds."""
    c = graph.loo_coverage(_edges(spark, folder), _groups(spark, folder)).select("id", "coverage")
    rows = _spreads(spark, folder).join(c, "id").join(_model_rows(spark, folder).select(F.col("vec_id").alias("id"), "y"), "id")
    middle = F.col("y") - (F.col("lo") + F.col("hi")) / 2
    rows = stored(rows.select(F.col("model").alias("fold"), "id", F.round("coverage", 6).alias("coverage"), F.round("spread", 6).alias("spread"), (middle * middle).alias("square")), "spreads")
    return rounded(gate.hybrid(rows, 5, [0.2, 0.5, 0.8, 1.0]), rmse_retained=4)


def _studies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of the first five groups as the known study, the others as a new one."""
    rows = _model_rows(spark, folder).select(F.col("vec_id").alias("id"), "grp", (F.col("y") + 5).alias("y"), F.array(*[F.col(f"f{i}") for i in range(5)]).alias("x"))
    return rows.where("grp < 5"), rows.where("grp >= 5")


def adaptation_draws(spark: SparkSession, folder: str) -> DataFrame:
    """What a gate retains of a new study once 0 to 40 of its rows have joined the bank, by draw and rule."""
    out = adaptation.adapted(*_studies(spark, folder), 5, [0, 5, 10, 40], [0, 1, 2], 41.0, cutoff=10.0)
    return rounded(out)


def adaptation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The draws' means and deviations by number of added rows and rule."""
    return rounded(adaptation.summary(adaptation.adapted(*_studies(spark, folder), 5, [0, 10], [0, 1, 2], 41.0, cutoff=10.0)))


def sampled_bank(spark: SparkSession, folder: str) -> DataFrame:
    """A bank of two studies: all vectors of the first five groups and forty others drawn by a hash."""
    e = _groups(spark, folder)
    return e.where("grp < 5").unionByName(models.sampled(e.where("grp >= 5"), "id", 40, 7)).orderBy("id")


def served_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector served by a version of the model that was trained on all of them, stored and read back."""
    rows = _model_rows(spark, folder).select(F.col("vec_id").alias("id"), "grp", "y", *COLUMNS[:5])
    shelf = artifacts.Artifacts(spark, f"{shared_root(spark)}/attestor/served-{uuid.uuid4().hex}")
    shelf.train(rows, COLUMNS[:5], 41.0, rounds=5)
    shelf.rewrite_gate(50.0)
    return rounded(shelf.serve(rows))


def archived_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events written to zip archives, a member for each user, and read back: rows, sums and unreadable members by kind."""
    at = f"{shared_root(spark)}/attestor/archives-{uuid.uuid4().hex}"
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    written = archives.write_members(e, at, "user_id", spoiled=1)
    back = archives.members(spark, at, "member string, event_id long, user_id long, event_type string, value double")
    rows = back.groupBy(F.element_at(F.split("member", r"\."), -1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("members"), F.sum("value").alias("total"), F.countDistinct("event_type").alias("types"))
    bad = archives.rejects(spark, at, "event_id long").agg((F.count(F.lit(1)) - written).alias("n")).select(F.lit("beyond the spoiled").alias("kind"), "n", *[F.lit(0).cast(t).alias(c) for c, t in (("members", "long"), ("total", "double"), ("types", "long"))])
    return rounded(rows.unionByName(bad), 3)


def search_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of a search page made from events: those from 2024 on with a title, by identity."""
    e = table(spark, folder, "events")
    item = F.concat(F.lit('{"data":[{"title":"t'), (F.col("event_id") % 50).cast("string"), F.lit('","year":'), (2020 + F.col("event_id") % 8).cast("string"), F.lit(',"externalIds":{"DOI":'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"10.1/X'), (F.col("event_id") % 20).cast("string"), F.lit('"'))).otherwise("null"), F.lit("}}]}"))
    return feeds.search_results(e.select(item.alias("payload")), "payload").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.min("year").cast("int").alias("first_year"))


def step_features(spark: SparkSession, folder: str) -> DataFrame:
    """Discharged value and charging minutes per user and day from event types as statuses."""
    status = F.when(F.col("event_type") == "purchase", "CC Discharge").when(F.col("event_type") == "view", "cc charge").otherwise("rest")
    e = table(spark, folder, "events").select("user_id", F.floor(seconds("ts") / 86400).cast("long").alias("day"), "ts", status.alias("status"), "value", seconds("ts").alias("s"))
    return rounded(cycles.step_summary(e, "user_id", "day", "ts", "status", "value", "s"))


def reference_screen(spark: SparkSession, folder: str) -> DataFrame:
    """Slow full cycles among lines, screened at 110 % of the nameplate price."""
    l = table(spark, folder, "lineitem")
    slow = cycles.reference_tests(l, "l_discount", "l_quantity", "l_tax", 0.05, 20.0, 0.05)
    kept, audit = cycles.screened(slow, "l_extendedprice", 40000.0, "l_returnflag")
    return audit.join(kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("kept")), "l_returnflag", "left")


def finite_series(spark: SparkSession, folder: str) -> DataFrame:
    """Positive values, one of each user and whole value, in order of time."""
    e = table(spark, folder, "events").withColumn("cycle", F.col("value") / 10)
    return rounded(cycles.finite_series(e, "user_id", "cycle", "value", "ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cycle").alias("cycles"), F.sum("value").alias("total")))


def longest_file(spark: SparkSession, folder: str) -> DataFrame:
    """The longest source of every language, as the longest file of a series."""
    d = table(spark, folder, "documents").select("lang", "source", "n_chars")
    return cycles.longest_file(d, "lang", "source").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


QUERIES = {f.__name__: f for f in (gbt_cv, graph_gbt_cv, fold_graph_rows, quantile_spread, spread_gate, adaptation_draws, adaptation_summary, served_predictions, archived_events, residual_band, predict_with_gate, sampled_bank, search_feed, step_features, reference_screen, finite_series, longest_file)}
ORACLE = {
    "fold_graph_rows": f"""WITH {_sql("behavior")}, {_FOLDS} SELECT f.fold, z.id, z.grp = f.fold AS is_test, round(fs.nbr_mean, 6) AS behavior_nbr_mean, round(fs.nbr_std, 6) AS behavior_nbr_std,
        round(fs.mean_weight, 6) AS behavior_mean_weight, round(coalesce(fs.coverage, 0), 6) AS behavior_coverage FROM z CROSS JOIN folds f LEFT JOIN fs ON fs.fold = f.fold AND fs.src = z.id""",
    "archived_events": """SELECT CASE user_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE 'npz' END AS kind, count(*) AS n, count(DISTINCT user_id) AS members, round(sum(value), 3) AS total, count(DISTINCT event_type) AS types
        FROM events GROUP BY 1 UNION ALL SELECT 'beyond the spoiled', 0, 0, 0, 0""",
    "search_feed": """WITH p AS (SELECT event_id, 2020 + event_id % 8 AS year FROM events), k AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'doi:10.1/x' || (event_id % 20)
        ELSE 'title:' || substring(sha1('t' || (event_id % 50)), 1, 16) END AS candidate_id FROM p WHERE year >= 2024) SELECT candidate_id, count(*) AS n, min(year)::INT AS first_year FROM k GROUP BY 1""",
    "step_features": """WITH e AS (SELECT user_id, floor(epoch_us(ts) / 1e6 / 86400)::BIGINT AS day, ts, epoch_us(ts) / 1e6 AS s, event_type, value FROM events)
        SELECT user_id, day, round(CASE WHEN count(*) FILTER (event_type = 'purchase') >= 2 THEN (arg_min(value, ts) FILTER (event_type = 'purchase') - arg_max(value, ts) FILTER (event_type = 'purchase')) / 1000 END, 6) AS discharged_ah,
               round(CASE WHEN count(*) FILTER (event_type = 'view') >= 2 THEN (max(s) FILTER (event_type = 'view') - min(s) FILTER (event_type = 'view')) / 60 END, 6) AS charge_min FROM e GROUP BY 1, 2""",
    "reference_screen": """WITH s AS (SELECT * FROM lineitem WHERE l_discount <= 0.05 AND l_quantity >= 20 AND abs(l_tax) <= 0.05)
        SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_extendedprice > 1.1::DOUBLE * 40000) AS dropped, count(*) FILTER (NOT l_extendedprice > 1.1::DOUBLE * 40000) AS kept FROM s GROUP BY 1""",
    "finite_series": """WITH g AS (SELECT user_id, round(value / 10)::BIGINT AS cycle, value, row_number() OVER (PARTITION BY user_id, round(value / 10)::BIGINT ORDER BY ts) AS r FROM events WHERE value > 0)
        SELECT user_id, count(*) AS n, sum(cycle)::BIGINT AS cycles, round(sum(value), 6) AS total FROM g WHERE r = 1 GROUP BY 1""",
    "longest_file": """WITH n AS (SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2)
        SELECT lang, source, n, chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM n) WHERE r = 1""",
}
