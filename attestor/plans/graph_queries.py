"""Queries over the similarity graph of ``embeddings``: coverage, folds, gates, risk.

A vector is an instance, its label the policy group.  The behaviour view has the first eight dimensions, the condition
view the next three.  The quantity to predict is log10(vec_id + 100).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import gate, graph, stats
from attestor.plans.common import rounded, table
from attestor.storage import stored

VIEWS = {"behavior": range(0, 8), "condition": range(8, 11)}
QS = [0.0, 10.0, 25.0, 41.0, 60.0, 80.0, 95.0]
RATIOS = [0.01, 0.1, 0.79, 1.0, 1.58, 3.16, 10.0]


def _vectors(spark: SparkSession, folder: str, view: str = "behavior") -> DataFrame:
    return graph.features(table(spark, folder, "embeddings"), "vec_id", "label", {f"f{i}": F.col("embedding")[i] for i in VIEWS[view]})


def _edges(spark: SparkSession, folder: str, view: str = "behavior", k: int = 10) -> DataFrame:
    return stored(graph.similarity_edges(_vectors(spark, folder, view), view, k), "edges")


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"))


def _targets(groups: DataFrame) -> DataFrame:
    return groups.select("id", F.log10(F.col("id") + 100.0).alias("y"))


def _sql(view: str = "behavior", k: int = 10) -> str:
    """CTEs z (scaled vectors), p (pairs) and e (stored edges)."""
    dims = [i + 1 for i in VIEWS[view]]
    z = ", ".join(
        f"(embedding[{d}]::DOUBLE - avg(embedding[{d}]::DOUBLE) OVER ()) / coalesce(nullif(stddev_pop(embedding[{d}]::DOUBLE) OVER (), 0), 1) AS f{d}" for d in dims
    )
    square = " + ".join(f"(a.f{d} - b.f{d}) * (a.f{d} - b.f{d})" for d in dims)
    return f"""z AS (SELECT vec_id AS id, label AS grp, log10(vec_id + 100.0) AS y, {z} FROM embeddings),
    p AS (SELECT a.id AS src, b.id AS dst, 1 / (1 + sqrt({square})) AS weight, a.grp = b.grp AS same_group FROM z a JOIN z b ON a.id <> b.id),
    e AS (SELECT src, dst, round(weight, 6) AS weight, same_group FROM
          (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM p) WHERE r <= {k})"""


_FOLDS = """folds AS (SELECT DISTINCT grp AS fold FROM z),
    fe AS (SELECT * FROM (SELECT f.fold, e.src, e.dst, e.weight, s.grp = f.fold AS is_test, d.y,
               row_number() OVER (PARTITION BY f.fold, e.src ORDER BY e.weight DESC, e.dst) AS r
           FROM e JOIN z d ON d.id = e.dst JOIN z s ON s.id = e.src JOIN folds f ON d.grp <> f.fold) WHERE r <= 5),
    m AS (SELECT fold, src, is_test, sum(weight * y) / sum(weight) AS nbr_mean, avg(weight) AS mean_weight, sum(weight) AS coverage FROM fe GROUP BY ALL),
    fs AS (SELECT m.fold, m.src, m.is_test, m.nbr_mean, sqrt(sum(fe.weight * (fe.y - m.nbr_mean) ^ 2) / sum(fe.weight)) AS nbr_std, m.mean_weight, m.coverage
           FROM fe JOIN m ON fe.fold = m.fold AND fe.src = m.src GROUP BY ALL),
    pr AS (SELECT fold, src AS id, round(coverage, 6) AS coverage, round(nbr_std, 6) AS spread, pow(src + 100.0 - pow(10, nbr_mean), 2) AS square FROM fs WHERE is_test),
    be AS (SELECT f.fold, e.src, e.weight, row_number() OVER (PARTITION BY f.fold, e.src ORDER BY e.weight DESC, e.dst) AS r
           FROM e JOIN z d ON d.id = e.dst JOIN z s ON s.id = e.src JOIN folds f ON d.grp <> f.fold AND s.grp <> f.fold WHERE d.grp <> s.grp),
    bs AS (SELECT fold, src, sum(weight) AS coverage FROM be WHERE r <= 5 GROUP BY ALL),
    bank AS (SELECT f.fold, z.id, round(coalesce(bs.coverage, 0), 6) AS coverage FROM z JOIN folds f ON z.grp <> f.fold LEFT JOIN bs ON bs.fold = f.fold AND bs.src = z.id)"""
_LOO = """l AS (SELECT src, sum(weight) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e WHERE NOT same_group)
          WHERE r <= 5 GROUP BY src),
    loo AS (SELECT z.id, z.grp, round(coalesce(l.coverage, 0), 6) AS coverage FROM z LEFT JOIN l ON l.src = z.id)"""
_RISK = """t AS (SELECT coverage AS threshold, count(*) AS n, sum(square) AS s FROM pr GROUP BY 1),
    rc AS (SELECT threshold, CAST(sum(n) OVER w AS BIGINT) AS n_retained, sum(n) OVER w / (SELECT count(*) FROM pr) AS frac_retained,
               sqrt(sum(s) OVER w / sum(n) OVER w) AS rmse_retained FROM t WINDOW w AS (ORDER BY threshold DESC))"""


def knn_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of every vector over its ten stored neighbours, with and without its own group."""
    return rounded(graph.coverage(_groups(spark, folder).select("id"), _edges(spark, folder)))


def knn_edges(view: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _edges(spark, folder, view)

    return query


def _fold_rows(spark: SparkSession, folder: str) -> DataFrame:
    groups = _groups(spark, folder)
    edges = graph.fold_edges(_edges(spark, folder), groups)
    return graph.neighbour_statistics(edges, _targets(groups), ("fold", "src", "is_test"))


def _held_out(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row predicted by its neighbours outside its own group, stored."""
    rows = graph.neighbour_statistics(graph.held_out_edges(edges, groups), _targets(groups), ("fold", "src"))
    square = F.pow(F.col("src") + 100.0 - F.pow(F.lit(10.0), F.col("nbr_mean")), F.lit(2.0))
    return stored(rows.select("fold", F.col("src").alias("id"), F.round("coverage", 6).alias("coverage"), F.round("nbr_std", 6).alias("spread"), square.alias("square")), "predictions")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _held_out(_edges(spark, folder), _groups(spark, folder))


def _banked(edges: DataFrame, groups: DataFrame) -> DataFrame:
    return stored(gate.fold_banks(edges, groups).withColumn("coverage", F.round("coverage", 6)), "banks")


def _banks(spark: SparkSession, folder: str) -> DataFrame:
    return _banked(_edges(spark, folder), _groups(spark, folder))


def _gate(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and banks over one set of edges."""
    edges, groups = _edges(spark, folder), _groups(spark, folder)
    return _held_out(edges, groups), _banked(edges, groups)


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    return stored(gate.quantile_curve(*_gate(spark, folder), QS, "square"), "curve")


def logo_fold_features(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbour statistics of every vector with each group held out in turn."""
    return rounded(_fold_rows(spark, folder))


def knn_neighbor_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbour statistics over the five best stored edges."""
    return rounded(graph.neighbour_statistics(graph.top_edges(_edges(spark, folder), 5), _targets(_groups(spark, folder))))


def knn_query_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Five neighbours outside the own group for every hundredth vector, against all vectors."""
    v = _vectors(spark, folder)
    return rounded(graph.nearest(v.where("id % 100 = 0"), v, 5, exclude_group=True))


def query_graph_features(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbour statistics and coverage of every hundredth vector, scaled and searched over the whole bank."""
    e = table(spark, folder, "embeddings")
    bank = e.select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.log10(F.col("vec_id") + 100.0).alias("y"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in VIEWS["behavior"]])
    return rounded(graph.query_features(bank.where("id % 100 = 0"), bank, [f"f{i}" for i in VIEWS["behavior"]]))


def knn_distances(spark: SparkSession, folder: str) -> DataFrame:
    """The three smallest distances of every hundredth vector, in order."""
    v = _vectors(spark, folder)
    near = graph.nearest(v.where("id % 100 = 0"), v, 3)
    return near.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.round(1 / F.col("weight") - 1, 4))), lambda x: x.cast("string")), ";").alias("distances"))


def loo_coverage_xgroup(spark: SparkSession, folder: str) -> DataFrame:
    """Leave-one-out coverage, own group excluded."""
    return rounded(graph.loo_coverage(_edges(spark, folder), _groups(spark, folder)))


def cross_set_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the graph over two joined studies (even and odd ids) by whether they cross."""
    e = _edges(spark, folder)
    return e.groupBy(((F.col("src") % 2) != (F.col("dst") % 2)).alias("crosses")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def fold_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """The 41st percentile of each fold's training bank."""
    return rounded(gate.fold_thresholds(_banks(spark, folder), 41))


def gate_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Which predictions the gate retains."""
    predictions, banks = _gate(spark, folder)
    kept = gate.decisions(predictions, gate.fold_thresholds(banks, 41))
    return rounded(kept.select("fold", "id", "coverage", "threshold", "retained"))


def quantile_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Retention, risk and error share for a grid of percentiles."""
    return rounded(_curve(spark, folder), rmse=4)


def cost_optimum(spark: SparkSession, folder: str) -> DataFrame:
    """The cheapest percentile for each cost ratio."""
    return rounded(gate.cheapest(_curve(spark, folder), RATIOS))


def threshold_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A percentile per group with the whole bank's for small groups."""
    return rounded(gate.bank_threshold(_edges(spark, folder), _groups(spark, folder), 41, least=50))


def excess_costs(spark: SparkSession, folder: str) -> DataFrame:
    """What the deployed percentile (41) costs beyond the best one, for each cost ratio."""
    return rounded(gate.excess_cost(_curve(spark, folder), RATIOS, 41.0))


def implied_cost_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """The cost ratios that the deployed percentile (41) implies."""
    return rounded(gate.implied_ratio(_curve(spark, folder), RATIOS, 41.0))


def fold_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """Mean percentile rank of each prediction's coverage in its fold's bank."""
    return rounded(gate.percentile_of(*_gate(spark, folder)))


def risk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Risk among the rows that each threshold retains."""
    return rounded(gate.risk_coverage(_predictions(spark, folder), "coverage", "square"), rmse_retained=4)


def aurc(spark: SparkSession, folder: str) -> DataFrame:
    """Area under the risk-coverage curve."""
    return rounded(gate.area(gate.risk_coverage(_predictions(spark, folder), "coverage", "square")), 4)


def hybrid_gate(spark: SparkSession, folder: str) -> DataFrame:
    """A gate on coverage and spread with thresholds from the other folds."""
    return rounded(gate.hybrid(_predictions(spark, folder), 5, [0.2, 0.5, 0.8, 1.0]), rmse_retained=3)


def aurc_interval(spark: SparkSession, folder: str) -> DataFrame:
    """The area under the risk-coverage curve with its interval over drawn folds."""
    return rounded(gate.bootstrap_area(_predictions(spark, folder), "coverage", "square"), 4)


def hybrid_interval(spark: SparkSession, folder: str) -> DataFrame:
    """The area under the hybrid gate's curve with its interval over drawn folds."""
    return rounded(gate.bootstrap_hybrid(_predictions(spark, folder), 5, [i / 20 for i in range(1, 21)]), 4)


def risk_coverage_random(spark: SparkSession, folder: str) -> DataFrame:
    """Risk among the rows that each threshold retains, and among random rows as many."""
    return rounded(gate.risk_coverage_random(_predictions(spark, folder), "id", "coverage", "square"), rmse_retained=4, rmse_random=4)


def coverage_signals_k(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-group coverage of both views for several k, and their mean."""
    out = _groups(spark, folder).select("id")
    for view in VIEWS:
        edges = _edges(spark, folder, view)
        for k in (3, 5, 10):
            name = f"{view}_k{k}"
            sums = graph.ranked_sum(edges, k, ~F.col("same_group"), name).withColumnRenamed("src", "id")
            out = out.join(sums, "id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return rounded(out.withColumn("mean_k5", (F.col("behavior_k5") + F.col("condition_k5")) / 2), mean_k5=7)


def bottom_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors with the least coverage outside their group."""
    c = graph.coverage(_groups(spark, folder).select("id"), _edges(spark, folder))
    return rounded(c.orderBy(F.round("coverage_xgroup", 6).asc_nulls_last(), "id").limit(10))


def optional_match_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The four best edges of every vector with the neighbour's label, which may be missing."""
    e = graph.top_edges(_edges(spark, folder), 4)
    names = _groups(spark, folder).where("grp < 5").select(F.col("id").alias("dst"), F.col("grp").alias("dst_label"))
    return e.join(names, "dst", "left").select("src", "dst", "weight", "dst_label")


def query_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """All answers of the neighbour query for each vector, view and k, as a table."""
    ks = spark.range(3, 6).select(F.col("id").cast("int").alias("k"))
    both = _edges(spark, folder, "behavior").unionByName(_edges(spark, folder, "condition"))
    from pyspark.sql import Window

    w = Window.partitionBy("view", "src").orderBy(F.desc("weight"), "dst")
    ranked = both.withColumn("rank", F.row_number().over(w)).where("rank <= 5").join(F.broadcast(ks), F.col("rank") <= F.col("k"))
    return ranked.groupBy("view", "src", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"].cast("string")), ",").alias("answer"))


def edge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of both views: number, inside groups, mean and least weight."""
    both = _edges(spark, folder, "behavior").unionByName(_edges(spark, folder, "condition"))
    return rounded(both.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.count_if("same_group").alias("inside"), F.avg("weight").alias("mean_weight"), F.min("weight").alias("least_weight")))


def spearman_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of coverage and squared error."""
    p = _predictions(spark, folder).withColumn("square", F.round("square", 6))
    return rounded(stats.spearman(p, "coverage", "square"))


def fold_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Signed rank comparison of the folds' errors with and without weights."""
    p = _predictions(spark, folder)
    all_mean = p.groupBy("fold").agg(F.sqrt(F.avg("square")).alias("risk"), F.sqrt(F.avg(F.when(F.col("coverage") > 1.5, F.col("square")))).alias("kept"))
    return rounded(stats.wilcoxon(all_mean.select(F.round(F.col("kept") - F.col("risk"), 4).alias("d")).dropna(), "d"))


QUERIES = {
    "knn_coverage": knn_coverage, "knn_edges_behavior": knn_edges("behavior"), "knn_edges_condition": knn_edges("condition"),
    "knn_neighbor_stats": knn_neighbor_stats, "knn_query_topk": knn_query_topk, "query_graph_features": query_graph_features, "knn_distances": knn_distances, "loo_coverage_xgroup": loo_coverage_xgroup,
    "cross_set_edges": cross_set_edges, "logo_fold_features": logo_fold_features, "fold_thresholds": fold_thresholds, "gate_decisions": gate_decisions,
    "quantile_curve": quantile_curve, "cost_optimum": cost_optimum, "excess_costs": excess_costs, "implied_cost_ratio": implied_cost_ratio, "threshold_fallback": threshold_fallback, "fold_percentile": fold_percentile,
    "risk_coverage": risk_coverage, "aurc": aurc, "hybrid_gate": hybrid_gate, "aurc_interval": aurc_interval, "hybrid_interval": hybrid_interval, "risk_coverage_random": risk_coverage_random, "coverage_signals_k": coverage_signals_k, "bottom_coverage": bottom_coverage,
    "optional_match_topk": optional_match_topk, "query_snapshot": query_snapshot, "edge_counts": edge_counts, "spearman_coverage": spearman_coverage,
    "fold_wins": fold_wins,
}

_COVERAGE = """a AS (SELECT src, sum(weight) AS c FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e) WHERE r <= 5 GROUP BY src),
    x AS (SELECT src, sum(weight) AS c FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e WHERE NOT same_group) WHERE r <= 5 GROUP BY src),
    cov AS (SELECT z.id, round(coalesce(a.c, 0), 6) AS coverage_all, round(coalesce(x.c, 0), 6) AS coverage_xgroup FROM z LEFT JOIN a ON a.src = z.id LEFT JOIN x ON x.src = z.id)"""
_B, _C = _sql("behavior"), _sql("condition")
_PRED = f"WITH {_B}, {_FOLDS}"
_QS, _PS = ", ".join(f"{q}::DOUBLE" for q in QS), ", ".join(str(q / 100) for q in QS)
_CURVE = f"""cuts AS (SELECT fold, unnest([{_QS}]) AS q, unnest(quantile_cont(coverage, [{_PS}])) AS threshold FROM bank GROUP BY fold),
    each AS (SELECT c.q, c.threshold, pr.square, pr.coverage >= c.threshold AS keep FROM pr JOIN cuts c ON pr.fold = c.fold),
    ag AS (SELECT q, count(*) FILTER (keep) / count(*) AS retention, sqrt(sum(square) FILTER (keep) / nullif(count(*) FILTER (keep), 0)) AS rmse,
               coalesce(sum(square) FILTER (keep), 0) / sum(square) AS error_share FROM each GROUP BY q),
    curve AS (SELECT ag.*, mt.threshold FROM ag JOIN (SELECT q, quantile_cont(threshold, 0.5) AS threshold FROM cuts GROUP BY q) mt ON mt.q = ag.q)"""


def _sums(name: str, edges: str, k: int) -> str:
    return f"(SELECT src, sum(weight) AS c FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM {edges} WHERE NOT same_group) WHERE r <= {k} GROUP BY src) {name}"


def _both() -> str:
    two = _C.replace("z AS (", "z2 AS (", 1).replace("p AS (", "p2 AS (", 1).replace("e AS (SELECT src", "e2 AS (SELECT src", 1).replace("FROM z a JOIN z b", "FROM z2 a JOIN z2 b").replace("AS r FROM p)", "AS r FROM p2)")
    return f"{_B}, {two}, b AS (SELECT 'behavior' AS view, * FROM e UNION ALL SELECT 'condition', * FROM e2)"


_SIGNALS = [(v, e, k) for v, e in (("behavior", "e"), ("condition", "e2")) for k in (3, 5, 10)]
ORACLE = {
    "knn_coverage": f"WITH {_B}, {_COVERAGE} SELECT * FROM cov",
    "knn_edges_behavior": f"WITH {_B} SELECT 'behavior' AS view, * FROM e",
    "knn_edges_condition": f"WITH {_C} SELECT 'condition' AS view, * FROM e",
    "knn_neighbor_stats": f"""WITH {_B}, t AS (SELECT e.*, z.y FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e) e JOIN z ON z.id = e.dst WHERE r <= 5),
        m AS (SELECT src, sum(weight * y) / sum(weight) AS nbr_mean, avg(weight) AS mean_weight, sum(weight) AS coverage FROM t GROUP BY src)
        SELECT t.src, round(any_value(nbr_mean), 6) AS nbr_mean, round(sqrt(sum(weight * (y - nbr_mean) ^ 2) / sum(weight)), 6) AS nbr_std,
               round(any_value(mean_weight), 6) AS mean_weight, round(any_value(coverage), 6) AS coverage FROM t JOIN m ON t.src = m.src GROUP BY t.src""",
    "knn_query_topk": f"""WITH {_B} SELECT src, dst, round(weight, 6) AS weight, same_group FROM
        (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM p WHERE NOT same_group AND src % 100 = 0) WHERE r <= 5""",
    "query_graph_features": f"""WITH {_B}, n AS (SELECT p.src, p.weight, d.y, row_number() OVER (PARTITION BY p.src ORDER BY p.weight DESC, p.dst) AS r FROM p JOIN z d ON d.id = p.dst WHERE p.src % 100 = 0),
        t AS (SELECT *, sum(weight * y) OVER w / sum(weight) OVER w AS m FROM n WHERE r <= 5 WINDOW w AS (PARTITION BY src))
        SELECT src AS id, round(any_value(m), 6) AS nbr_mean, round(sqrt(sum(weight * (y - m) ^ 2) / sum(weight)), 6) AS nbr_std, round(avg(weight), 6) AS mean_weight, round(sum(weight), 6) AS coverage FROM t GROUP BY src""",
    "knn_distances": f"""WITH {_B} SELECT src, string_agg(CAST(round(1 / weight - 1, 4) AS VARCHAR), ';' ORDER BY weight DESC) AS distances FROM
        (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM p WHERE src % 100 = 0) WHERE r <= 3 GROUP BY src""",
    "loo_coverage_xgroup": f"WITH {_B}, {_LOO} SELECT * FROM loo",
    "cross_set_edges": f"WITH {_B} SELECT src % 2 <> dst % 2 AS crosses, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM e GROUP BY 1",
    "logo_fold_features": f"{_PRED} SELECT fold, src, is_test, round(nbr_mean, 6) AS nbr_mean, round(nbr_std, 6) AS nbr_std, round(mean_weight, 6) AS mean_weight, round(coverage, 6) AS coverage FROM fs",
    "fold_thresholds": f"{_PRED} SELECT fold, round(quantile_cont(coverage, 0.41), 6) AS threshold FROM bank GROUP BY fold",
    "gate_decisions": f"""{_PRED}, t AS (SELECT fold, quantile_cont(coverage, 0.41) AS threshold FROM bank GROUP BY fold)
        SELECT pr.fold, pr.id, pr.coverage, round(t.threshold, 6) AS threshold, pr.coverage >= t.threshold AS retained FROM pr JOIN t ON pr.fold = t.fold""",
    "quantile_curve": f"{_PRED}, {_CURVE} SELECT q::DOUBLE AS q, round(retention, 6) AS retention, round(rmse, 4) AS rmse, round(error_share, 6) AS error_share, round(threshold, 6) AS threshold FROM curve",
    "cost_optimum": f"""{_PRED}, {_CURVE}, rt AS (SELECT * FROM (VALUES {", ".join(f"({r}::DOUBLE)" for r in RATIOS)}) v(ratio)),
        c AS (SELECT ratio, q, round(ratio * (1 - retention) + error_share, 9) AS cost FROM curve, rt)
        SELECT ratio, q::DOUBLE AS q, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY cost, q) AS r FROM c) WHERE r = 1""",
    "excess_costs": f"""{_PRED}, {_CURVE}, rt AS (SELECT * FROM (VALUES {", ".join(f"({r}::DOUBLE)" for r in RATIOS)}) v(ratio)),
        c AS (SELECT ratio, q, ratio * (1 - retention) + error_share AS cost FROM curve, rt), x AS (SELECT ratio, max(cost) FILTER (q = 41) AS cost, min(cost) AS least FROM c GROUP BY 1)
        SELECT ratio, round(cost, 6) AS cost, round(least, 6) AS least, round(100 * (cost / least - 1), 6) AS excess_pct FROM x""",
    "implied_cost_ratio": f"""{_PRED}, {_CURVE}, rt AS (SELECT * FROM (VALUES {", ".join(f"({r}::DOUBLE)" for r in RATIOS)}) v(ratio)),
        c AS (SELECT ratio, q::DOUBLE AS q, ratio * (1 - retention) + error_share AS cost FROM curve, rt),
        x AS (SELECT ratio, arg_min(q, round(cost, 9) * 1e6 + q * 1e-6) AS best_q, 100 * (max(cost) FILTER (q = 41) / min(cost) - 1) AS e FROM c GROUP BY 1)
        SELECT bool_or(best_q = 41) AS exactly_optimal, min(ratio) FILTER (best_q = 41) AS ratio_lo, max(ratio) FILTER (best_q = 41) AS ratio_hi,
        arg_min(ratio, abs(best_q - 41) * 1e3 + ratio) AS closest_ratio, arg_min(best_q, abs(best_q - 41) * 1e3 + ratio) AS closest_q, round(min(e), 6) AS min_excess_pct,
        arg_min(ratio, round(e, 6) * 1e6 + ratio) AS ratio_at_min_excess, min(ratio) FILTER (e <= 5) AS near_lo, max(ratio) FILTER (e <= 5) AS near_hi FROM x""",
    "threshold_fallback": f"""WITH {_B}, {_LOO} SELECT grp, count(*) AS n,
        round(CASE WHEN count(*) < 50 THEN (SELECT quantile_cont(coverage, 0.41) FROM loo) ELSE quantile_cont(coverage, 0.41) END, 6) AS threshold, count(*) < 50 AS whole FROM loo GROUP BY grp""",
    "fold_percentile": f"""{_PRED} SELECT pr.fold, pr.id, round((count(*) FILTER (b.coverage < pr.coverage) + count(*) FILTER (b.coverage <= pr.coverage)) / 2 / count(*) * 100, 6) AS percentile
        FROM pr JOIN bank b ON b.fold = pr.fold GROUP BY pr.fold, pr.id""",
    "risk_coverage": f"{_PRED}, {_RISK} SELECT threshold, n_retained, round(frac_retained, 6) AS frac_retained, round(rmse_retained, 4) AS rmse_retained FROM rc",
    "aurc": f"""{_PRED}, {_RISK}, k AS (SELECT frac_retained AS x0, rmse_retained AS y0, lead(frac_retained) OVER w AS x1, lead(rmse_retained) OVER w AS y1 FROM rc WINDOW w AS (ORDER BY frac_retained)),
        gr AS (SELECT 0.2::DOUBLE + i * (0.8::DOUBLE / 160) AS g FROM range(161) t(i)), lo AS (SELECT min(x0) AS x, arg_min(y0, x0) AS y FROM k),
        y AS (SELECT g, CASE WHEN g < lo.x THEN lo.y ELSE (SELECT CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (g - x0) / (x1 - x0) * (y1 - y0) END FROM k WHERE x0 <= g AND (x1 IS NULL OR g < x1)) END AS v FROM gr, lo)
        SELECT round(sum(a) / 0.8, 4) AS aurc FROM (SELECT (v + lead(v) OVER (ORDER BY g)) / 2 * (lead(g) OVER (ORDER BY g) - g) AS a FROM y)""",
    "hybrid_gate": f"""{_PRED}, pt AS (SELECT i / 4 AS f FROM range(5) t(i)),
        tc AS (SELECT '-inf'::DOUBLE AS t_cov UNION SELECT quantile_cont(coverage, [0, 0.25, 0.5, 0.75, 1])[i] FROM pr, range(1, 6) t(i) GROUP BY i),
        ts AS (SELECT 'inf'::DOUBLE AS t_spr UNION SELECT quantile_cont(spread, [0, 0.25, 0.5, 0.75, 1])[i] FROM pr, range(1, 6) t(i) GROUP BY i),
        own AS (SELECT fold, t_cov, t_spr, count(*) AS n, count(*) FILTER (coverage >= t_cov AND spread <= t_spr) AS kept, coalesce(sum(square) FILTER (coverage >= t_cov AND spread <= t_spr), 0) AS error
                FROM pr, tc, ts GROUP BY ALL),
        rest AS (SELECT *, sum(n) OVER w - n AS rn, sum(kept) OVER w - kept AS rk, sum(error) OVER w - error AS re FROM own WINDOW w AS (PARTITION BY t_cov, t_spr)),
        lv AS (SELECT * FROM (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) v(level)),
        rk AS (SELECT level, fold, n, kept, error, row_number() OVER (PARTITION BY level, fold ORDER BY CASE WHEN rk > 0 THEN round(sqrt(greatest(re, 0) / rk), 6) ELSE 'inf'::DOUBLE END, -(rk / rn), t_cov, -t_spr) AS r
               FROM rest, lv WHERE rk / rn >= level - 1e-12)
        SELECT level, round(sum(kept) / sum(n), 6) AS frac_retained, round(sqrt(sum(error) / nullif(sum(kept), 0)), 3) AS rmse_retained FROM rk WHERE r = 1 GROUP BY level""",
    "coverage_signals_k": f"WITH {_both()} SELECT z.id, "
    + ", ".join(f"round(coalesce({v}{k}.c, 0), 6) AS {v}_k{k}" for v, _, k in _SIGNALS)
    + ", round((coalesce(behavior5.c, 0) + coalesce(condition5.c, 0)) / 2, 7) AS mean_k5 FROM z "
    + " ".join(f"LEFT JOIN {_sums(f'{v}{k}', e, k)} ON {v}{k}.src = z.id" for v, e, k in _SIGNALS),
    "bottom_coverage": f"WITH {_B}, {_COVERAGE} SELECT * FROM cov ORDER BY coverage_xgroup, id LIMIT 10",
    "optional_match_topk": f"""WITH {_B} SELECT t.src, t.dst, t.weight, CASE WHEN z.grp < 5 THEN z.grp END AS dst_label FROM
        (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e) t JOIN z ON z.id = t.dst WHERE r <= 4""",
    "query_snapshot": f"""WITH {_both()}, r AS (SELECT *, row_number() OVER (PARTITION BY view, src ORDER BY weight DESC, dst) AS rank FROM b)
        SELECT view, src, k::INT AS k, string_agg(dst::VARCHAR, ',' ORDER BY rank) AS answer FROM r, range(3, 6) t(k) WHERE rank <= k GROUP BY view, src, k""",
    "edge_counts": f"WITH {_both()} SELECT view, count(*) AS n, count(*) FILTER (same_group) AS inside, round(avg(weight), 6) AS mean_weight, min(weight) AS least_weight FROM b GROUP BY view",
    "spearman_coverage": f"""{_PRED}, s AS (SELECT coverage, round(square, 6) AS square FROM pr),
        r AS (SELECT rank() OVER (ORDER BY coverage) + (count(*) OVER (PARTITION BY coverage) - 1) / 2 AS a, rank() OVER (ORDER BY square) + (count(*) OVER (PARTITION BY square) - 1) / 2 AS b FROM s)
        SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""",
    "fold_wins": f"""{_PRED}, f AS (SELECT fold, round(sqrt(avg(square) FILTER (coverage > 1.5)) - sqrt(avg(square)), 4) AS d FROM pr GROUP BY fold),
        u AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM f WHERE d <> 0),
        s AS (SELECT count(*) AS n, count(*) FILTER (d < 0) AS wins, count(*) FILTER (d > 0) AS losses, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down FROM u)
        SELECT n, wins, losses, least(up, down)::DOUBLE AS w, round((least(up, down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s""",
}
