"""Queries of what surrounds a study: units, replies, partial scores, configurations, flags, composed answers, frozen edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import names as nm
from attestor.operators import claims, stats, studies
from attestor.plans import eval_queries, graph_queries, series_queries, store_queries
from attestor.plans.common import rounded, table
from attestor.storage import shared_root, stored


def extraction_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of the tables of documents: whole grids, and rows of tables written from parts of a brand."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains("|"))
    d = table(spark, folder, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("region_id"), F.transform(lines, lambda r: F.split(r, r"\|")).alias("rows")).where("size(rows) > 0")
    row = F.array(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "none stated").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" g\n or so\n"))))
    p = table(spark, folder, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("a"))
    both = d.unionByName(p.select(F.col("p_brand").alias("region_id"), F.transform("a", lambda x: x["r"]).alias("rows")))
    units = studies.extraction_units(both.select("region_id", nm.region_kind(F.col("rows")).alias("kind"), "rows"))
    return units.select("region_id", "unit_id", "kind", F.md5("render").alias("digest"))


def grid_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of grids that replies name, written from parts, by what is wrong with them; composed names of the others."""
    k = F.col("p_partkey")
    cell = F.format_string('{"family": "%s", "axis_kind": "current_a", "axis_value": "%d", "value": %d, "unit": "%%"}', F.when(k % 7 == 0, "mass").otherwise(nm.FAMILIES[0]), "p_size", k)
    reply = F.when(k % 5 == 0, F.concat(F.lit("[{\"family\": \"rel_capacity\", \"value\": 3}, "), cell, F.lit("]"))).when(k % 5 == 1, "none").when(k % 5 == 2, F.replace(cell, F.lit("current_a"), F.lit("speed"))).otherwise(F.concat(F.lit("```json\n["), cell, F.lit("]\n```")))
    out = studies.grid_replies(table(spark, folder, "part").select("p_partkey", reply.alias("reply")), "reply")
    return out.groupBy("error", "property").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("replies"))


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, folder, "conversations").select("conv_id", F.when(n % 3 == 0, "tp").when(n % 3 == 1, "fp").otherwise("fn").alias("outcome"), (n % 2 == 0).alias("in_source"))


def partial_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every conversation's claims; a third of them has no source text to check against."""
    sources = table(spark, folder, "conversations").select("conv_id", F.when(F.col("conv_id") % 3 != 0, F.col("text")).alias("text"))
    return rounded(studies.partial_scores(_outcomes(spark, folder), sources, "conv_id"))


def compared_configurations(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of lines as proposed, after consensus and after validation, against those of orders that are finished."""
    l = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), "l_quantity", "l_linestatus")
    gold = l.where("l_linestatus = 'F' and l_quantity > 10")
    of = lambda name, cond: l.where(cond).select(F.lit(name).alias("config"), "part", "line")
    said = of("raw", "l_quantity > 5").unionByName(of("consensus", "l_quantity > 15")).unionByName(of("validated", "l_quantity > 15 and l_quantity < 45"))
    return rounded(studies.compared_configurations(gold, said, ["part", "line"], [("consensus", "raw"), ("validated", "consensus")]))


def paired_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with orders of both states, as documents that both annotators have."""
    o = table(spark, folder, "orders")
    return studies.paired_documents(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", strict=False)


def review_flags(spark: SparkSession, folder: str) -> DataFrame:
    """What a person should see of a study's cells before approving them."""
    tidy = series_queries._tidy(spark, folder)
    lives = series_queries.series.lives(tidy, "cell", "cycle", "cap").select("cell", "n_cycles", "life", "init", "flags", "anomalous")
    rules = {
        "short_series": (F.col("flags").contains("short_series"), "note the ageing cycles beside the flag"), "anomalous": (F.col("anomalous"), "load it, and leave it out of models"),
        "no_life": (F.col("life").isNull(), "treat it as censored"), "low_start": (F.col("init") < 1.0, "check the first cycles"),
    }
    return studies.review_flags(lives, rules)


def evaluation_set(spark: SparkSession, folder: str) -> DataFrame:
    """Cells without any flag but a short series, as rows of the bank: constants, no batch, the logarithm of the last cycle."""
    tidy = series_queries._tidy(spark, folder)
    lives = series_queries.series.lives(tidy, "cell", "cycle", "cap").where("array_except(split(flags, ','), array('short_series', 'no_eol_reached', '')) = array()")
    return rounded(lives.select("cell", F.lit("events").alias("study"), F.lit(None).cast("int").alias("batch"), F.log10("last_cycle").alias("y")))


def guarded_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of predicted prices by flag and line; small sets give their counts alone."""
    l = table(spark, folder, "lineitem").select(F.concat("l_returnflag", (F.col("l_suppkey") % 40).cast("string"), F.when(F.col("l_quantity") == 7, "x").otherwise("")).alias("variant"), "l_linenumber", "l_extendedprice", (F.col("l_quantity") * 1000).alias("predicted"))
    return rounded(studies.guarded_metrics(l, "variant", "l_linenumber", "l_extendedprice", "predicted"), 4)


def promises(spark: SparkSession, folder: str) -> DataFrame:
    """For each part what is claimed and measured, and the gap that was stored for it."""
    p = table(spark, folder, "part")
    measured = stored(store_queries._prices(spark, folder).select("p_partkey", F.col("price").alias("value")), "measured")
    gaps = stored(claims.claim_gaps(p.select("p_partkey", "p_retailprice"), measured, "p_partkey", "p_retailprice", "value").select("p_partkey", "n", "gap"), "gaps")
    said = p.select("p_partkey", F.explode(F.array(F.col("p_retailprice"), F.col("p_size").cast("double"))).alias("claim"))
    out = studies.promises(p, said, measured, gaps, "p_partkey")
    return rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("median", "q1", "q3", "gap")}), 7)  # engines interpolate halves to either side


def independent_measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements written from lines, numbered by supplier and property, without empty conditions."""
    l = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    rows = l.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_quantity", "l_tax")).alias("x")).select(
        F.concat(F.lit("s"), F.col("x.l_suppkey").cast("string")).alias("doc"), F.when(F.col("l_linenumber") % 2 == 0, "mass_g").otherwise("height_mm").alias("property"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order"),
        F.when(F.col("x.l_quantity") % 9 != 0, F.col("x.l_quantity").cast("double")).alias("value"), F.create_map(F.lit("tax"), F.when(F.col("x.l_tax") > 0.03, F.col("x.l_tax").cast("double")), F.lit("line"), F.col("l_linenumber").cast("double")).alias("conditions"),
    )
    out = studies.independent_measurements(rows, "doc", "order")
    return rounded(out.select("measurement_id", "order", "value", "chart_only", F.size("conditions").alias("conditions")))


def checked_omissions(spark: SparkSession, folder: str) -> DataFrame:
    """Properties that documents are said to lack, verified against their whole texts, by language."""
    d = table(spark, folder, "documents").where("doc_id is not null")
    words = spark.createDataFrame([("license", "(?i)license"), ("contact", "@"), ("number", r"\d")], "property string, pattern string")
    omitted = d.select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit("license"), F.lit("contact"), F.lit("number"), F.lit("unknown"))).alias("property"))
    out = studies.checked_omissions(omitted, d.select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("text")), words)
    return out.groupBy("property").agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("verified"))


def neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """The seven nearest vectors of the vector with the smallest id, with their labels."""
    e = stored(graph_queries._edges(spark, folder), "center-edges")
    names = graph_queries._groups(spark, folder).select("id", F.col("grp").cast("string").alias("name"))
    return studies.neighbourhood(e, "behavior", e.agg(F.min("src")).first()[0], 7, names)


def frozen_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of both views frozen once; what comes later changes nothing."""
    at = f"{shared_root(spark)}/attestor/frozen-{uuid.uuid4().hex}"
    first = studies.frozen_edges(graph_queries._edges(spark, folder, "behavior").unionByName(graph_queries._edges(spark, folder, "condition")), at)
    return studies.frozen_edges(first.withColumn("weight", F.col("weight") * 2), at)


def loaded_studies(spark: SparkSession, folder: str) -> DataFrame:
    """Three studies loaded one after the other: one complete, one without data, one that fails."""
    at = f"{shared_root(spark)}/attestor/studies-{uuid.uuid4().hex}"
    broken = lambda: table(spark, folder, "nation").select(F.raise_error(F.lit("unreadable")).alias("x"))
    return studies.loaded(spark, {"events": lambda: series_queries._tidy(spark, folder), "absent": lambda: None, "broken": broken}, at).withColumn("detail", F.when(F.col("state") != "failed", F.col("detail")).otherwise(""))


QUERIES = {f.__name__: f for f in (
    extraction_units, grid_replies, partial_scores, compared_configurations, paired_documents, review_flags, evaluation_set, guarded_metrics, promises, independent_measurements, checked_omissions, neighbourhood,
    frozen_edges, loaded_studies,
)}

_LIVES = series_queries._life(nominal=False).replace(series_queries._CYC, series_queries._STEPS + ", c AS (SELECT cell, cycle, cap FROM td0 WHERE cap > 0)")
_REGIONS = eval_queries.ORACLE["table_regions"]
ORACLE = {
    "extraction_units": f"""WITH g AS ({_REGIONS}), pr AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_size FROM part)
        SELECT 'd' || doc_id AS region_id, 'd' || doc_id || '_grid' AS unit_id, kind, digest FROM g WHERE kind = 'grid'
        UNION ALL SELECT p_brand, p_brand || '_r' || i, 'spec_row', md5('Item: ' || p_name || chr(10) || 'Specification:' || chr(10) || '  ' || p_size || ' g' || chr(10) || '  or so') FROM pr WHERE p_partkey % 3 <> 0""",
    "partial_scores": """WITH c AS (SELECT conv_id, length(text) % 3 AS o, length(text) % 2 = 0 AS held FROM conversations), s AS (SELECT conv_id, count(*) FILTER (o = 0) AS tp, count(*) FILTER (o = 1) AS fp, count(*) FILTER (o = 2) AS fn,
            count(*) FILTER (o = 1 AND NOT held) AS absent FROM c GROUP BY 1), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM s)
        SELECT conv_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1,
               CASE WHEN conv_id % 3 <> 0 THEN absent END AS hallucinations, CASE WHEN conv_id % 3 <> 0 THEN 'available' ELSE 'unavailable' END AS source_checks FROM p""",
    "compared_configurations": """WITH g AS (SELECT DISTINCT l_partkey AS p, l_linenumber AS l FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 10),
        s AS (SELECT DISTINCT config, l_partkey AS p, l_linenumber AS l FROM lineitem, (VALUES ('raw', 5, 999), ('consensus', 15, 999), ('validated', 15, 45)) v(config, a, b) WHERE l_quantity > a AND l_quantity < b),
        h AS (SELECT config, count(*) AS predicted, count(g.p) AS tp FROM s LEFT JOIN g ON g.p = s.p AND g.l = s.l GROUP BY 1), m AS (SELECT *, predicted - tp AS fp, (SELECT count(*) FROM g) - tp AS fn FROM h),
        q AS (SELECT *, tp / predicted AS precision, tp / (tp + fn) AS recall FROM m),
        x AS (SELECT st.config, count(*) AS offered, count(*) FILTER (k.p IS NULL) AS gone FROM (VALUES ('consensus', 'raw'), ('validated', 'consensus')) st(config, before) JOIN s ON s.config = st.before JOIN g ON g.p = s.p AND g.l = s.l
              LEFT JOIN s k ON k.config = st.config AND k.p = s.p AND k.l = s.l GROUP BY 1)
        SELECT q.config, predicted, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, gone AS false_rejections, round(gone / offered, 6) AS false_rejection_rate
        FROM q LEFT JOIN x ON x.config = q.config""",
    "paired_documents": "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_reference, count(*) FILTER (o_orderstatus = 'O') AS n_second FROM orders GROUP BY 1 HAVING n_reference > 0 AND n_second > 0",
    "review_flags": f"""WITH {_LIVES}, a AS (SELECT cell, 'short_series' AS flag, 'note the ageing cycles beside the flag' AS recommendation FROM lf WHERE contains(flags, 'short_series')
            UNION ALL SELECT cell, 'anomalous', 'load it, and leave it out of models' FROM lf WHERE {series_queries._ANOMALOUS} UNION ALL SELECT cell, 'no_life', 'treat it as censored' FROM lf WHERE life IS NULL
            UNION ALL SELECT cell, 'low_start', 'check the first cycles' FROM lf WHERE init < 1.0)
        SELECT flag, recommendation, count(*) AS n, array_to_string((list(cell ORDER BY cell))[:20], ',') AS cells FROM a GROUP BY 1, 2""",
    "evaluation_set": f"""WITH {_LIVES} SELECT cell, 'events' AS study, NULL::INT AS batch, round(log10(last_cycle), 6) AS y FROM lf
        WHERE len(list_filter(string_split(flags, ','), lambda f: f NOT IN ('short_series', 'no_eol_reached', ''))) = 0""",
    "guarded_metrics": """WITH l AS (SELECT l_returnflag || (l_suppkey % 40) || CASE WHEN l_quantity = 7 THEN 'x' ELSE '' END AS variant, l_linenumber, l_extendedprice AS t, l_quantity * 1000 AS p FROM lineitem),
        a AS (SELECT variant, count(*) AS n, count(DISTINCT l_linenumber) AS groups, sqrt(avg(pow(t - p, 2))) AS rmse, avg(abs(t - p) / abs(t)) * 100 AS mape FROM l GROUP BY 1)
        SELECT variant, n, groups, CASE WHEN n >= 20 AND groups >= 3 THEN round(rmse, 4) END AS rmse, CASE WHEN n >= 20 AND groups >= 3 THEN round(mape, 4) END AS mape FROM a""",
    "promises": f"""WITH {store_queries._PRICES}, m AS (SELECT l_partkey AS k, count(price) AS n, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM pr GROUP BY 1)
        SELECT p_partkey, 2 AS n_claims, round(least(p_retailprice, p_size), 7) AS least_claim, round(greatest(p_retailprice, p_size), 7) AS most_claim, coalesce(n, 0) AS n, round(median + 1e-9, 7) AS median, round(q1 + 1e-9, 7) AS q1, round(q3 + 1e-9, 7) AS q3,
               round((median - p_retailprice) / nullif(abs(p_retailprice), 0) + 1e-9, 7) AS gap FROM part LEFT JOIN m ON k = p_partkey""",
    "independent_measurements": """WITH u AS (SELECT l_orderkey * 10 + l_linenumber AS o, l_linenumber AS n, min(row(l_suppkey, l_quantity, l_tax)) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
        r AS (SELECT 's' || x[1] AS doc, CASE WHEN n % 2 = 0 THEN 'mass_g' ELSE 'height_mm' END AS property, o, x[2]::DOUBLE AS q, x[3]::DOUBLE AS tax FROM u)
        SELECT doc || ':' || property || ':' || (row_number() OVER (PARTITION BY doc, property ORDER BY o) - 1) AS measurement_id, o AS "order", CASE WHEN q % 9 <> 0 THEN q END AS value, q % 9 = 0 AS chart_only,
               CASE WHEN tax > 0.03 THEN 2 ELSE 1 END AS conditions FROM r""",
    "checked_omissions": r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN text END AS t FROM documents WHERE doc_id IS NOT NULL), w AS (SELECT * FROM (VALUES ('license', '(?i)license'), ('contact', '@'), ('number', '\d'), ('unknown', NULL)) v(property, p))
        SELECT property, count(*) AS n, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL AND NOT regexp_matches(t, p)) AS verified FROM d, w GROUP BY 1""",
    "neighbourhood": f"""WITH {graph_queries._sql("behavior")}, b AS (SELECT dst, weight, row_number() OVER (ORDER BY weight DESC, dst) AS rank FROM e WHERE src = (SELECT min(src) FROM e))
        SELECT rank, dst, weight, grp::VARCHAR AS name FROM b JOIN z ON z.id = dst WHERE rank <= 7""",
    "frozen_edges": f"WITH {graph_queries._both()} SELECT view, src, dst, weight, same_group FROM b",
    "loaded_studies": f"WITH {_LIVES} SELECT 'events' AS study, 'loaded' AS state, count(*)::VARCHAR AS detail FROM c UNION ALL SELECT 'absent', 'skipped', 'no data' UNION ALL SELECT 'broken', 'failed', ''",
}
