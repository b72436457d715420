"""Queries of evaluations: conditions, names, table regions, lookups, inputs and rule checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import conditions as cn
from attestor.functions import names as nm
from attestor.functions import text as tx
from attestor.functions.values import close, unit_class
from attestor.operators import answers, matching, stats
from attestor.plans.common import rounded, table
from attestor.plans.graph_queries import _predictions

def _number_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with gold and predicted conditions as maps."""
    p = table(spark, folder, "part")
    s, k = F.col("p_size"), F.col("p_partkey")
    gold = F.when(k % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("rate"), F.concat(s.cast("string"), F.lit(" A"))))
    said = F.when(k % 5 == 0, s + 7).when(k % 5 == 1, s * 1000).otherwise(s)
    predicted = F.when(k % 3 == 0, F.create_map(F.lit("text"), F.lit("unspecified"))).otherwise(F.create_map(F.lit("rate"), said.cast("string"), F.lit("text"), F.lit("99")))
    return p.select("p_partkey", "p_brand", gold.alias("gold"), F.concat(F.lit("at "), s.cast("string")).alias("quote"), predicted.alias("predicted"))


def condition_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Right and over-extracted conditions of predictions by brand."""
    r = _number_rows(spark, folder)
    return r.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(cn.correct(F.col("gold"), F.col("quote"), F.col("predicted"))).alias("correct"),
        F.count_if(cn.over_extracted(F.col("gold"), F.col("quote"), F.col("predicted"))).alias("invented"),
    )


def grounded_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """How many conditions of a part stay when a page says its size only."""
    r = _number_rows(spark, folder).select("p_partkey", cn.grounded(F.col("predicted"), F.col("quote")).alias("g"))
    return r.select("p_partkey", F.size("g").alias("n"), F.coalesce(F.try_element_at("g", F.lit("text")), F.lit("")).alias("text"))


def condition_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How the conditions of two sides relate."""
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    side = lambda a, b: F.map_filter(F.create_map(F.lit("x"), F.when(k % a == 0, F.lit("1")).when(k % a == 1, F.lit("2")), F.lit("y"), F.when(k % b == 0, F.lit("3"))), lambda n, v: v.isNotNull())
    return p.groupBy(cn.outcome(side(3, 2), side(4, 5)).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def wrong_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Why answers about a part's size aren't right, with other sizes of its brand as variants."""
    p = table(spark, folder, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("s"))
    several = p.groupBy("p_brand").agg(F.collect_set("s").alias("all_sizes"))
    k = F.col("p_partkey")
    answer = F.when(k % 5 == 0, "I don't know").when(k % 5 == 1, F.format_string("%.0f Ah", F.col("s"))).when(k % 5 == 2, F.format_string("%.0f Ah", F.col("s") * 1000)).when(k % 5 == 3, "77 Ah").otherwise("none given")
    # equal answers to one question of a brand are judged once
    same = p.groupBy("p_brand", "s", answer.alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    r = same.join(several, "p_brand").select(answers.wrong_kind(F.col("answer"), F.array("s"), F.lit("Ah"), F.col("all_sizes")).alias("kind"), "n")
    return r.groupBy("kind").agg(F.sum("n").alias("n"))


def composed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Property names of parts by family and axis."""
    p = table(spark, folder, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    family = F.element_at(F.array(*map(F.lit, nm.FAMILIES)), (k % 3 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, nm.AXES)), (F.floor(k / 3) % 3 + 1).cast("int"))
    value = F.when(kind == "temperature_c", F.format_string("%.1f", F.when(k % 2 == 0, -size).otherwise(size))).when(kind == "current_a", F.format_string("%.4f", size / 8)).otherwise(F.when(k % 2 == 0, " Rapid ").otherwise("std"))
    return p.select("p_partkey", nm.property_name(family, kind, value).alias("name"))


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of documents begin a section of each number and title."""
    line = table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return line.groupBy(nm.section(F.col("line")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


def printed_values(spark: SparkSession, folder: str) -> DataFrame:
    """How sizes of two units may be printed, and printed lists read back."""
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("s"), F.when(F.col("p_partkey") % 2 == 0, "Ah").otherwise("g").alias("unit"))
    back = nm.parsed_value(F.concat(F.lit("["), F.col("s").cast("string"), F.lit(", 2]")))
    return p.select("p_partkey", F.array_join(nm.printed_forms(F.col("s"), F.col("unit")), ";").alias("forms"), F.aggregate(back, F.lit(0.0), lambda a, x: a + x).alias("total"))


def unit_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Physical classes of the words that follow the numbers of documents."""
    unit = F.regexp_extract_all("text", F.lit(r"\d ?([A-Za-z%]+)"), F.lit(1))
    units = table(spark, folder, "documents").select(F.explode(unit).alias("u"))
    return units.groupBy(unit_class(F.col("u")).alias("unit_class")).agg(F.count(F.lit(1)).alias("n"))


def table_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of the tables that documents hold as lines with bars, their quantity rows and how they read as text."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains("|"))
    d = table(spark, folder, "documents").select("doc_id", F.transform(lines, lambda r: F.split(r, r"\|")).alias("rows")).where("size(rows) > 0")
    rows = F.col("rows")
    return d.select("doc_id", nm.region_kind(rows).alias("kind"), F.size(nm.quantity_rows(rows)).alias("quantity_rows"), F.md5(nm.rendered(rows)).alias("digest"))


def lookup_with_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of a size within each brand, or all of the brand where none has it."""
    p = table(spark, folder, "part").select("p_brand", "p_partkey", "p_size")
    kept = answers.filter_if_any(p, ["p_brand"], F.col("p_size") == 7)
    return kept.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


def match_views(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of two suppliers on a part matched by flag and then by part alone."""
    l = table(spark, folder, "lineitem")
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = l.withColumn("pos", F.col("l_partkey") * 100_000 + F.row_number().over(w)).select("pos", "l_partkey", "l_linestatus", F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").cast("int").alias("side"), "l_returnflag", F.array("l_linestatus", F.col("l_linenumber").cast("string")).alias("words"))
    return matching.matched_views(rows.where("l_returnflag in ('A', 'R')"), ["l_partkey", "l_linestatus"], ["l_partkey"])


def claim_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of the conditions of consecutive benchmark items."""
    b = table(spark, folder, "benchmark").select("item_id", "text")
    both = b.alias("a").join(b.alias("b"), F.col("a.item_id") + 1 == F.col("b.item_id"))
    none = F.create_map().cast("map<string,string>")
    s = cn.similarity(none, F.col("a.text"), F.col("a.item_id") % 2, none, F.col("b.text"), F.col("b.item_id") % 2)
    return rounded(both.select("a.item_id", s.alias("similarity")))


def bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the error over folds drawn again."""
    return rounded(answers.bootstrap_rmse(_predictions(spark, folder), "fold", "square"), 4)


def input_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The range of a bank's features."""
    return rounded(answers.input_limits(table(spark, folder, "part"), ["p_size", "p_retailprice"]))


def refused_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Features of requests that lie outside the bank, by feature."""
    bank = table(spark, folder, "part").where("p_size between 5 and 45")
    limits = answers.input_limits(bank, ["p_size", "p_retailprice"])
    out = answers.refused_inputs(table(spark, folder, "part"), "p_partkey", limits, ["p_size", "p_retailprice"])
    return out.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("parts"))


def sanity_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that documents break, counted by level."""
    d = table(spark, folder, "documents").withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(F.md5("text"))))
    rules = {
        "empty": ("error", F.trim("text") == ""), "repeated": ("error", F.col("copies") > 1), "short": ("warning", F.col("n_chars") < 100),
        "length_differs": ("error", F.col("n_chars") != F.char_length("text")), "has_digits": ("info", F.col("text").rlike(r"\d")),
    }
    return answers.findings(d.select("doc_id", "text", "n_chars", "copies"), rules).groupBy("level", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def dataset_join(spark: SparkSession, folder: str) -> DataFrame:
    """Instances, features and labels joined one to one, with assertions instead of silent losses."""
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    checked = both.withColumn("y", F.when(F.col("o_totalprice") > 0, F.log10("o_totalprice")).otherwise(F.raise_error(F.lit("no target")).cast("double")))
    return rounded(checked.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("orders"), F.avg("y").alias("mean_log")))


def taxonomy_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Matches per document and overall, as one table with totals."""
    c = table(spark, folder, "conversations")
    tp, fp, fn = (F.count_if(F.char_length("text") % 3 == i) for i in range(3))
    r = c.rollup("role").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return rounded(r.select("role", "tp", "fp", "fn", *stats.scores(F.col("tp"), F.col("fp"), F.col("fn"))))


def false_acceptance(spark: SparkSession, folder: str) -> DataFrame:
    """Per threshold of coverage: accepted rows, those of them with a large error, and refused ones with a small error."""
    p = _predictions(spark, folder).withColumn("bad", F.sqrt("square") > 0.5 * (F.col("id") + 100))
    cuts = spark.createDataFrame([(x,) for x in (1.2, 1.5, 1.8, 2.1)], "threshold double")
    kept = F.col("coverage") >= F.col("threshold")
    return p.join(F.broadcast(cuts)).groupBy("threshold").agg(F.count_if(kept).alias("accepted"), F.count_if(kept & F.col("bad")).alias("false_accepted"), F.count_if(~kept & ~F.col("bad")).alias("useful_refused"))


def variant_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """All known values of each brand and container over two sources."""
    p = table(spark, folder, "part")
    both = p.select("p_brand", F.col("p_size").cast("double").alias("v")).unionByName(p.select("p_brand", F.floor("p_retailprice").cast("double").alias("v")))
    return both.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_set("v")), lambda x: x.cast("int").cast("string")), ",").alias("known"))


def precedents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by category with totals by language and the first three ids."""
    d = table(spark, folder, "documents").select("doc_id", "lang", F.when(F.col("text").rlike(r"\|"), "table").when(F.col("text").rlike(r"\d"), "numeric").otherwise("prose").alias("category"))
    w = Window.partitionBy("category", "lang").orderBy("doc_id")
    ranked = d.withColumn("r", F.row_number().over(w))
    return ranked.groupBy("category", "lang").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("doc_id")))), lambda x: x.cast("string")), ",").alias("examples"))


def close_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose price is within 2 % of that of the next line of their part, by flag."""
    w = Window.partitionBy("l_partkey").orderBy("l_extendedprice")
    l = table(spark, folder, "lineitem").withColumn("next", F.lead("l_extendedprice").over(w))
    return l.where(close(F.col("l_extendedprice"), F.col("next"))).groupBy(F.col("l_extendedprice") >= 20000).agg(F.count(F.lit(1)).alias("n")).toDF("dear", "n")


def answer_units(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and units in sentences made from parts."""
    unit = F.element_at(F.array(*map(F.lit, ("mAh", "V", "g", "cycles"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, folder, "part").select(F.explode(tx.answer_numbers(F.concat(F.lit("about −"), F.col("p_size"), F.lit(" "), unit, F.lit(" or 1,000")))).alias("a"))
    return rounded(p.groupBy("a.unit").agg(F.count(F.lit(1)).alias("n"), F.sum("a.n").alias("total")))


QUERIES = {f.__name__: f for f in (
    condition_scores, grounded_conditions, condition_outcomes, wrong_answers, composed_names, sections, printed_values, unit_classes, table_regions,
    lookup_with_filter, match_views, claim_similarity, bootstrap, input_limits, refused_inputs, sanity_findings, dataset_join, taxonomy_totals, false_acceptance,
    variant_catalog, precedents, close_prices, answer_units,
)}
_K = "p_partkey"
_SAID = f"CASE WHEN {_K} % 5 = 0 THEN p_size + 7 WHEN {_K} % 5 = 1 THEN p_size * 1000 ELSE p_size END"
_NEAR = "abs(a - b) <= 0.02 * greatest(a, b, 1e-9)"
from attestor.plans.graph_queries import _PRED  # noqa: E402

ORACLE = {
    "condition_scores": f"""WITH r AS (SELECT p_brand, {_K} % 4 = 0 AS none, {_K} % 3 = 0 AS silent, p_size::DOUBLE AS a, ({_SAID})::DOUBLE AS b FROM part)
        SELECT p_brand, count(*) AS n, count(*) FILTER (CASE WHEN none THEN silent OR {_NEAR} ELSE NOT silent AND {_NEAR} END) AS correct,
        count(*) FILTER (NOT silent AND NOT ({_NEAR} OR (b < 100 AND abs(b * 1000 - a) <= 0.02 * greatest(b * 1000, a)) OR (b >= 1000 AND abs(b / 1000 - a) <= 0.02 * greatest(b / 1000, a)))) AS invented FROM r GROUP BY 1""",
    "grounded_conditions": f"""WITH r AS (SELECT {_K}, {_K} % 3 = 0 AS silent, p_size::DOUBLE AS a, ({_SAID})::DOUBLE AS b FROM part),
        g AS (SELECT *, {_NEAR} OR (b < 100 AND abs(b * 1000 - a) <= 0.02 * greatest(b * 1000, a)) OR (b >= 1000 AND abs(b / 1000 - a) <= 0.02 * greatest(b / 1000, a)) AS ok FROM r)
        SELECT {_K}, CASE WHEN silent OR NOT ok THEN 1 ELSE 2 END AS n, CASE WHEN silent OR NOT ok THEN 'unspecified' ELSE '99' END AS text FROM g""",
    "condition_outcomes": f"""WITH s AS (SELECT CASE {_K} % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS ax, CASE WHEN {_K} % 2 = 0 THEN '3' END AS ay, CASE {_K} % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS bx, CASE WHEN {_K} % 5 = 0 THEN '3' END AS bw FROM part)
        SELECT CASE WHEN ax IS NULL AND ay IS NULL AND bx IS NULL AND bw IS NULL THEN 'both_unspecified' WHEN ax IS NULL AND ay IS NULL THEN 'b_only' WHEN bx IS NULL AND bw IS NULL THEN 'a_only'
        WHEN ax <> bx OR ay <> bw THEN 'conflicting'
        WHEN (ax IS NULL) = (bx IS NULL) AND (ay IS NULL) = (bw IS NULL) THEN 'identical'
        WHEN NOT ((bx IS NOT NULL AND ax IS NULL) OR (bw IS NOT NULL AND ay IS NULL)) THEN 'a_richer'
        WHEN NOT ((ax IS NOT NULL AND bx IS NULL) OR (ay IS NOT NULL AND bw IS NULL)) THEN 'b_richer' ELSE 'partial' END AS outcome, count(*) AS n FROM s GROUP BY 1""",
    "composed_names": f"""WITH p AS (SELECT {_K} AS k, p_size AS s FROM part)
        SELECT k AS {_K}, ['rel_discharge_capacity', 'rel_charge_capacity', 'rel_capacity'][k % 3 + 1] || '_' || CASE (k // 3) % 3 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'm' ELSE '' END || s || 'c_pct'
        WHEN 1 THEN replace(regexp_replace((s / 8.0)::DECIMAL(12, 3)::VARCHAR, '\\.?0+$', ''), '.', '_') || 'a_pct' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'rapid' ELSE 'std' END || '_charge_pct' END AS name FROM p""",
    "sections": r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
        m AS (SELECT regexp_extract(line, '^\s*''?"?(\d+(?:\.\d+)*)\s*([A-Za-z][^|:,;]{0,44})?', ['number', 'title']) AS g FROM l),
        t AS (SELECT g.number AS number, regexp_replace(g.title, '^[ ''"—-]+|[ ''"—-]+$', '', 'g') AS title FROM m)
        SELECT CASE WHEN number = '' THEN '—' WHEN title = '' THEN '§' || number ELSE '§' || number || ' ' || title END AS section, count(*) AS n FROM t GROUP BY 1""",
    "printed_values": f"""WITH p AS (SELECT {_K}, p_size / 4.0 AS s, {_K} % 2 = 0 AS milli, p_size % 4 = 0 AS whole FROM part),
        f AS (SELECT *, regexp_replace(s::DECIMAL(12, 2)::VARCHAR, '\\.?0+$', '') AS g FROM p)
        SELECT {_K}, concat_ws(';', g, CASE WHEN milli THEN (s * 1000)::BIGINT::VARCHAR END, CASE WHEN whole THEN g || '.0' END) AS forms, s + 2.0::DOUBLE AS total FROM f""",
    "unit_classes": r"""WITH u AS (SELECT lower(unnest(regexp_extract_all(text, '\d ?([A-Za-z%]+)', 1))) AS u FROM documents)
        SELECT CASE WHEN u IN ('mah', 'ah') THEN 'capacity' WHEN u IN ('ma', 'a') THEN 'current' WHEN u IN ('mv', 'v') THEN 'voltage' WHEN u = 'g' THEN 'mass' WHEN u IN ('h', 'min') THEN 'time'
        WHEN u = 'cycles' THEN 'count' WHEN u = '%' THEN 'share' WHEN u = 'degc' THEN 'temperature' WHEN u = 'mohm' THEN 'impedance' ELSE 'other:' || u END AS unit_class, count(*) AS n FROM u GROUP BY 1""",
    "table_regions": r"""WITH r AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: list_transform(string_split(x, '|'), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g')))) AS rows
        FROM documents WHERE contains(text, '|')), w AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width,
        len(list_filter(rows, lambda r: len(list_filter(r, lambda c: regexp_matches(c, '(?i)^[-−~]?\s*\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:%|℃|°C|mAh|Ah|mA|A|mV|V|mΩ|mOhm|cycles?|g|mm|min|h)?$'))) >= 2)) AS q FROM r WHERE len(rows) > 0)
        SELECT doc_id, CASE WHEN q >= 2 THEN 'grid' WHEN width = 2 AND len(rows) >= 4 THEN 'spec_table' ELSE 'other' END AS kind, q::INT AS quantity_rows,
        md5(array_to_string(list_transform(rows, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(width - len(r)), lambda i: '')), ' | ') || ' |'), chr(10))) AS digest FROM w""",
    "lookup_with_filter": """WITH p AS (SELECT *, bool_or(p_size = 7) OVER (PARTITION BY p_brand) AS known FROM part) SELECT p_brand, count(*) AS n, min(p_partkey) AS first_part FROM p WHERE p_size = 7 OR NOT known GROUP BY 1""",
    "claim_similarity": r"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark)
        SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM w a JOIN w b ON a.item_id + 1 = b.item_id""",
    "input_limits": """SELECT 'p_size' AS "column", min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part UNION ALL SELECT 'p_retailprice', round(min(p_retailprice), 6), round(max(p_retailprice), 6) FROM part""",
    "refused_inputs": """WITH b AS (SELECT min(p_size) AS a, max(p_size) AS z, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part WHERE p_size BETWEEN 5 AND 45),
        r AS (SELECT 'p_size' AS "column", p_partkey FROM part, b WHERE p_size < a OR p_size > z UNION ALL SELECT 'p_retailprice', p_partkey FROM part, b WHERE p_retailprice < c OR p_retailprice > d)
        SELECT "column", count(*) AS n, count(DISTINCT p_partkey) AS parts FROM r GROUP BY 1""",
    "sanity_findings": r"""WITH d AS (SELECT *, count(*) OVER (PARTITION BY text) AS copies FROM documents), f AS (SELECT doc_id, 'error' AS level, 'empty' AS rule FROM d WHERE trim(text) = ''
        UNION ALL SELECT doc_id, 'error', 'repeated' FROM d WHERE copies > 1 UNION ALL SELECT doc_id, 'warning', 'short' FROM d WHERE n_chars < 100
        UNION ALL SELECT doc_id, 'error', 'length_differs' FROM d WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'info', 'has_digits' FROM d WHERE regexp_matches(text, '\d'))
        SELECT level, rule, count(*) AS n, min(doc_id) AS first_doc FROM f GROUP BY 1, 2""",
    "dataset_join": """SELECT n_name, count(*) AS n, count(DISTINCT o_orderkey) AS orders, round(avg(log10(o_totalprice)), 6) AS mean_log
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "taxonomy_totals": """WITH c AS (SELECT role, count(*) FILTER (length(text) % 3 = 0) AS tp, count(*) FILTER (length(text) % 3 = 1) AS fp, count(*) FILTER (length(text) % 3 = 2) AS fn FROM conversations GROUP BY ROLLUP (role))
        SELECT role, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "false_acceptance": f"""{_PRED}, x AS (SELECT *, sqrt(square) > 0.5::DOUBLE * (id + 100) AS bad FROM pr), t AS (SELECT * FROM (VALUES (1.2::DOUBLE), (1.5), (1.8), (2.1)) v(threshold))
        SELECT threshold, count(*) FILTER (coverage >= threshold) AS accepted, count(*) FILTER (coverage >= threshold AND bad) AS false_accepted, count(*) FILTER (coverage < threshold AND NOT bad) AS useful_refused FROM x, t GROUP BY 1""",
    "variant_catalog": """WITH b AS (SELECT p_brand, p_size::INT AS v FROM part UNION SELECT p_brand, floor(p_retailprice)::INT FROM part) SELECT p_brand, string_agg(v::VARCHAR, ',' ORDER BY v) AS known FROM b GROUP BY 1""",
    "precedents": r"""WITH d AS (SELECT doc_id, lang, CASE WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '\d') THEN 'numeric' ELSE 'prose' END AS category FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY category, lang ORDER BY doc_id) AS r FROM d) SELECT category, lang, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (r <= 3) AS examples FROM r GROUP BY 1, 2""",
    "close_prices": """WITH l AS (SELECT l_extendedprice AS a, lead(l_extendedprice) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS b FROM lineitem)
        SELECT a >= 20000 AS dear, count(*) AS n FROM l WHERE abs(a - b) <= 0.02::DOUBLE * greatest(abs(a), abs(b)) GROUP BY 1""",
    "answer_units": """WITH p AS (SELECT ['mah', 'v', 'g', 'cycles'][p_partkey % 4 + 1] AS unit, -p_size::DOUBLE AS n FROM part UNION ALL SELECT '', 1000.0 FROM part) SELECT unit, count(*) AS n, round(sum(n), 6) AS total FROM p GROUP BY 1""",
}
