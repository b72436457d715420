"""Queries over specifications and claims: lines by rules, review pages, consistency of documents, kinds of claims, answers.

The given tables hold few such texts, so each query reads a whole table and writes the numbers of its rows into the lines,
pages and answers that it then reads; the lists of all pages are read as they are as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import claim_kinds as ck
from attestor.functions import conditions as cn
from attestor.functions import names as nm
from attestor.functions import reviews as rv
from attestor.functions import specifications as sp
from attestor.functions import text as tx
from attestor.operators import consistency
from attestor.plans.common import rounded, table

#: Lines that a part's size (a), key (k) and price without decimals (p) are written into.
LINES = [
    "Real capacity: {k}mAh, {a}.5 v", "nominal voltage: {a}.25V", "Recommended standard charge method: {k},000mA to 4.{a}V, later", "Quick: fast charge current: {a}A", "Max charge voltage: {a} V or less",
    "Max. charge current: {p}mA", "Standard discharge: {a}A down to 2.{a}V", "Fast discharge: {p}mA, {a}A", "Maximum continuous discharge: {a}.5A", "Pulse discharge of {k} ms: {a} A",
    "Cycle life at {a}C discharge, {k}% DOD: Over {p} cycles", "Cycle life: {p} at {a}A, {k} at 2{a}A, both with {a}.5A charge, until {a}%", "Cell net weight: Max. {a}.5 g", "A charge/cutoff voltage: {a}.5v to {a}v",
    "Cut off at {a}.75V, full charge {a}.9V", "Operating temperature: charge {a}~{k}°C, discharge: -{a}~{k}°C", "Operating temp: -{a}°C ~ +{k}°C", "Storage temperature: 1 month: 0~{k}°C, 1 year: -{a}°C ~ +{a}°C",
    "Colour {a}, made by {k} people",
]
#: What a page states about its own number (n), after its own text.
STATED = [
    "<p>At {n}A the cell reaches 8{n}°C. Nothing else.</p>", "<div>At 3{n}.5A I terminated due to temperature, it did reach 9{n} C!</div>", "<p>It may deliver {n}A, but only for two minutes</p>",
    "<p>I only discharge to 2.{n} volt</p><img src=\"a/b%20{n}-Capacity.png\">", "Official specifications: <ul><li>Mass: {n}<li><b>Size</b>  {n} mm</li></ul><img src=\"x/{n}-Energy.png\">", "",
]
PROPERTIES = ["rel_capacity_minus_10c", "max_charge_current_a", "storage_capacity_remaining_pct", "mass_g", "taper_current_a", "height_mm", "discharge_cutoff_v"]
NOTES = ["", "read from graph 3", "acceptance test"]
TEXTS = ["kept for three months", "at 25 degrees", "see graph"]


def _filled(templates: list[str], which: Column, **values: Column) -> Column:
    line = F.element_at(F.array(*map(F.lit, templates)), (which % len(templates) + 1).cast("int"))
    for name, value in values.items():
        line = F.replace(line, F.lit(f"{{{name}}}"), value.cast("string"))
    return line


def _filled_sql(templates: list[str], which: str, **values: str) -> str:
    line = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in templates) + f"][({which} % {len(templates)} + 1)::INT]"
    for name, value in values.items():
        line = f"replace({line}, '{{{name}}}', ({value})::VARCHAR)"
    return line


def _chosen(names: list[str], which: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (which % len(names) + 1).cast("int"))


def _chosen_sql(names: list[str], which: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][({which} % {len(names)} + 1)::INT]"


def _part_lines(spark: SparkSession, folder: str) -> DataFrame:
    price = F.floor("p_retailprice").cast("int")
    return table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", _filled(LINES, F.col("p_partkey"), a=F.col("p_size"), k=F.col("p_partkey") % 90 + 10, p=price).alias("line"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(id, line): the items of all pages' lists and a line of every part."""
    items = table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.explode(tx.list_items(F.coalesce("html", F.lit("")))).alias("line"))
    return items.unionByName(_part_lines(spark, folder).select((-F.col("p_partkey")).alias("id"), "line"))


def echo_rule_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the first rule that each line of pages and parts meets, by line."""
    e = _lines(spark, folder).select("id", F.posexplode(sp.entries(F.col("line"))).alias("pos", "e"))
    held = F.array_join(F.array_sort(F.transform(F.map_entries("e.conditions"), lambda p: F.concat(p["key"], F.lit("="), F.round(p["value"], 6).cast("string")))), ";")
    return rounded(e.select("id", "e.rule", "pos", "e.property", F.get("e.value", F.lit(0)).alias("v0"), F.get("e.value", F.lit(1)).alias("v1"), held.alias("conditions")))


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("page_id") % 7 + 1
    html = F.concat(F.coalesce("html", F.lit("")), F.lit("\n"), _filled(STATED, F.col("page_id"), n=number))
    return table(spark, folder, "pages").select("page_id", html.alias("html"))


def review_measurements(spark: SparkSession, folder: str) -> DataFrame:
    """What every page states or only shows: measurements with their conditions and fragments."""
    m = rv.assembled(_reviews(spark, folder), "html", "page_id").select("page_id", F.explode("measurements").alias("m")).select("page_id", "m.*")
    held = F.array_join(F.transform(F.map_entries("conditions"), lambda p: F.concat(p["key"], F.lit("="), p["value"].cast("string"))), ";")
    return m.select("page_id", "property", "value", "unit", held.alias("conditions"), "chart_only", "fragment")


def review_echoes(spark: SparkSession, folder: str) -> DataFrame:
    """The official specifications that a page repeats, and how many measurements it states or shows."""
    r = rv.assembled(_reviews(spark, folder), "html", "page_id")
    return r.select("page_id", F.array_join("spec_echo", "|").alias("echo"), "n_stated", "n_charts")


def _entries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Gold claims of line items and echoes of parts, by brand as model."""
    part = _part_lines(spark, folder)
    each = part.select(F.col("p_brand").alias("model"), F.concat(F.lit("review_"), (F.col("p_size") % 4).cast("string")).alias("source_id"), F.col("p_partkey").alias("pos"), "line", F.explode(sp.entries(F.col("line"))).alias("e"))
    echoes = each.select("model", "source_id", "e.property", (F.col("pos") * 2 + F.col("e.rule") % 2).alias("pos"), "e.value", "e.conditions", F.col("line").alias("text"))
    l = table(spark, folder, "lineitem").join(table(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    prop = _chosen(["mass_g", "max_charge_voltage_v", "fast_charge_current_a", "cycle_life_cycles"], F.col("l_linenumber"))
    capped = F.when(F.col("l_linenumber") % 3 == 0, F.lit("at least")).when(F.col("l_linenumber") % 3 == 1, F.lit("max.")).otherwise(F.lit("typical"))
    end = F.when(F.col("l_linestatus") == "F", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" % left")))
    gold = l.select(
        F.col("p_brand").alias("model"), F.concat(F.lit("datasheet_"), "l_returnflag").alias("source_id"), prop.alias("property"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.array(F.col("l_quantity").cast("double")).alias("value"), F.lit("A").alias("unit"), F.create_map(F.lit("discharge_c_rate"), F.col("l_discount").cast("double") * 100).alias("conditions"),
        end.alias("end_condition"), capped.alias("text"), F.col("l_returnflag").alias("notes"),
    )
    return consistency.gold_entries(gold), echoes


def gold_entry_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of claims by model, document and property, with the conditions that their end conditions add."""
    kept = F.try_element_at("conditions", F.lit("retention_pct"))
    g = _entries(spark, folder)[0].groupBy("model", "source_id", "property")
    return rounded(g.agg(F.count(F.lit(1)).alias("n"), F.count(kept).alias("with_retention"), F.sum(kept).alias("retention"), F.max(F.char_length("text")).alias("longest")))


def spec_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts and gaps of every entry of each two documents on a model, by model, documents and property."""
    gold, echoes = _entries(spark, folder)
    omissions = table(spark, folder, "part").select(F.col("p_brand").alias("model"), F.lit("review_3").alias("source_id"), F.lit("cycle_life_cycles").alias("property")).distinct()
    rows = consistency.consistency(gold, echoes, omissions)
    out = rows.groupBy("model", "source_a", "source_b", "property", "verdict", "provenance").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("detail").endswith("verified omission")).alias("verified")
    )
    return rounded(out)


def policy_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Two-step policies written from parts, and page addresses, which are none; their three numbers."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    step = F.concat(F.when(k % 3 == 0, F.concat(size, F.lit(".5"))).otherwise(size), F.lit("C("), (k % 100).cast("string"), F.lit("%)-"), size, F.lit("C"))
    text = F.when(k % 7 == 0, F.concat(F.lit("  "), step, F.lit("-newstructure"))).when(k % 11 == 0, "   ").when(k % 13 == 0, F.col("p_type")).otherwise(step)
    both = table(spark, folder, "part").select(k.alias("id"), text.alias("line")).unionByName(table(spark, folder, "pages").select((-F.col("page_id") - 1).alias("id"), F.col("url").alias("line")))
    d = both.select("id", tx.policy_name(F.col("line")).alias("policy"))
    return d.select("id", "policy", F.inline_outer(F.array(tx.policy_parts(F.col("policy")))))


def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of every turn as an answer to a question of one value; hedging and sources by outcome."""
    c, n = table(spark, folder, "conversations"), F.col("conv_id") % 20 + 1
    said = F.when(F.col("turn") % 4 == 0, F.format_string(" It is %d.5 Ah, see page %d", n, F.col("turn"))).when(F.col("turn") % 4 == 1, F.format_string(" About %d,500 mAh", n)).when(F.col("turn") % 4 == 2, F.format_string(" Perhaps %d500 Ah", n)).otherwise("")
    d = c.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), said).alias("answer"), F.array(n + 0.5).alias("gold"))
    return d.select("conv_id", "turn", tx.score_value(F.col("answer"), F.col("gold"), F.lit("Ah")).alias("outcome"), tx.hedges(F.col("answer")).alias("hedged"), tx.names_source(F.col("answer")).alias("sourced"))


def answers_with_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """Whether answers about parts state the conditions of the gold."""
    k, size = F.col("p_partkey"), F.col("p_size")
    answer = F.when(k % 4 == 0, F.format_string("at %d A and %d °C", size, k % 60)).when(k % 4 == 1, F.format_string("at %d mA", size * 1000)).when(k % 4 == 2, "somehow").otherwise(F.format_string("%d.5 A", size))
    gold = F.when(k % 5 == 0, F.create_map(F.lit("text"), size.cast("string"))).when(k % 5 < 3, F.create_map(F.lit("rate"), size.cast("string"))).otherwise(F.create_map(F.lit("rate"), size.cast("string"), F.lit("t"), (k % 60).cast("string")))
    return table(spark, folder, "part").select("p_partkey", cn.stated_in(answer, gold).alias("stated"))


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    """(id, doc, property, unit, notes, conditions) written from line items."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        key.alias("id"), F.concat("l_returnflag", "l_linestatus").alias("doc"), _chosen(PROPERTIES, F.col("l_partkey")).alias("property"), F.when(F.col("l_suppkey") % 5 == 0, "mm").otherwise("A").alias("unit"),
        _chosen(NOTES, F.col("l_suppkey")).alias("notes"), _chosen(TEXTS, F.col("l_orderkey")).alias("conditions"),
    )


_CLAIMS = f"""c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag || l_linestatus AS doc, {_chosen_sql(PROPERTIES, "l_partkey")} AS property, CASE WHEN l_suppkey % 5 = 0 THEN 'mm' ELSE 'A' END AS unit,
    {_chosen_sql(NOTES, "l_suppkey")} AS notes, {_chosen_sql(TEXTS, "l_orderkey")} AS conditions FROM lineitem)"""


def claim_strata(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of each document by where they stand in it."""
    c = _claims(spark, folder)
    return c.groupBy("doc", ck.stratum(F.col("property"), F.col("notes"), F.col("conditions")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def _categorised(spark: SparkSession, folder: str) -> DataFrame:
    c = _claims(spark, folder)
    return c.withColumn("category", ck.category(F.col("property"), F.col("unit"), F.col("notes"), F.col("conditions")))


def claim_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The first category that each claim meets, counted by property."""
    return _categorised(spark, folder).groupBy("property", "category").agg(F.count(F.lit(1)).alias("n"))


def claim_precedents(spark: SparkSession, folder: str) -> DataFrame:
    """Per category how many claims there are, in how many documents, and the three smallest ids as examples."""
    c = _categorised(spark, folder)
    per = c.groupBy("category", "doc").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"))
    rest = c.join(per.select("category", "doc", "a"), ["category", "doc"]).where("id > a").groupBy("category", "doc").agg(F.min("id").alias("b"))
    third = c.join(rest, ["category", "doc"]).where("id > b").groupBy("category", "doc").agg(F.min("id").alias("c"))
    first = per.join(rest, ["category", "doc"], "left").join(third, ["category", "doc"], "left")
    ids = F.flatten(F.collect_list(F.array_compact(F.array("a", "b", "c"))))  # three for each document at most
    docs = F.array_join(F.array_sort(F.collect_list(F.concat("doc", F.lit("="), F.col("n").cast("string")))), ",")
    return first.groupBy("category").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs_with"), docs.alias("documents"), F.array_join(F.transform(F.slice(F.array_sort(ids), 1, 3), lambda x: x.cast("string")), ",").alias("examples"))


def file_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The fields that the names of files encode: names written from parts, and the addresses of pages, which encode none."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.concat(F.lit("a/b/SNL_18650_LFP_"), size, F.lit("C_"), (k % 50).cast("string"), F.lit("-100_0."), size, F.lit("-"), (k % 4).cast("string"), F.lit(".0C_"), F.lit("r"), size, F.when(k % 6 == 0, "_timeseries.csv").otherwise("_cycle_data.csv"))
    both = table(spark, folder, "part").select(k.alias("id"), name.alias("name")).unionByName(table(spark, folder, "pages").select((-F.col("page_id") - 1).alias("id"), F.col("url").alias("name")))
    return both.select("id", F.inline_outer(F.array(ck.file_fields(F.coalesce("name", F.lit(""))))))


def value_on_page(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the value of a claim stands on the turn that it cites, on another one of its conversation, or nowhere."""
    c = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    pages = c.select("doc", "page", F.concat(F.coalesce("text", F.lit("")), F.format_string(" holds %d,%03d mAh", F.col("page") + 1, F.col("doc") % 1000)).alias("text"))
    value = (F.col("page") + 1 + (F.col("doc") % 2) * 3) + F.col("doc") % 1000 / 1000.0
    claims = c.select("doc", "page", nm.printed_forms(F.round(value, 3), F.lit("Ah")).alias("forms"))
    out = consistency.verified_on_page(claims, pages)
    return out.select("doc", "page", "status", "other_pages")


QUERIES = {f.__name__: f for f in (
    echo_rule_cascade, review_measurements, review_echoes, gold_entry_conditions, spec_consistency, policy_parse, answer_scores, answers_with_conditions, claim_strata, claim_categories, claim_precedents,
    file_fields, value_on_page,
)}

_ITEMS = r"""items AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(parts[i], '(?is)</(?:li|ul|ol)>.*$', ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS line
    FROM (SELECT page_id, regexp_split_to_array(html, '(?i)<li[^>]*>') AS parts FROM pages), range(2, len(parts) + 1) t(i))"""
_LINES = f"""lines AS (SELECT page_id AS id, line FROM items WHERE line <> '' UNION ALL
    SELECT -p_partkey AS id, {_filled_sql(LINES, "p_partkey", a="p_size", k="p_partkey % 90 + 10", p="floor(p_retailprice)::INT")} AS line FROM part)"""
_REVIEWS = f"""h AS (SELECT page_id, coalesce(html, '') || chr(10) || {_filled_sql(STATED, "page_id", n="page_id % 7 + 1")} AS html FROM pages),
    x AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '<img[^>]*>', ' ', 'g'), '<[^>]+>', chr(10), 'g'), '[ \t]+', ' ', 'g') AS t FROM h),
    s AS (SELECT page_id, regexp_replace(regexp_replace(unnest(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))), '^\\s+', ''), '\\s+$', '') AS s FROM x),
    st AS (SELECT page_id, s, regexp_extract(s, '(?i)At (\\d+(?:\\.\\d+)?)A the cell reaches (\\d+)\\s?°?C', ['a', 'b']) AS p1,
        regexp_extract(s, '(?is)At (\\d+(?:\\.\\d+)?)A I terminated due to temperature.*?reach (\\d+)\\s?°?C', ['a', 'b']) AS p2,
        regexp_extract(s, '(?i)deliver (\\d+(?:\\.\\d+)?)A, but only for (\\w+) minutes?', ['a', 'b']) AS p3, regexp_extract(s, '(?i)I only discharges? to (\\d+(?:\\.\\d+)?) volt', ['a']) AS p4 FROM s),
    ms AS (SELECT page_id, 'measured_cell_temp_c' AS property, p1.b::DOUBLE AS value, 'degC' AS unit, 'discharge_current_a=' || p1.a::DOUBLE AS conditions, false AS chart_only, s[:240] AS fragment FROM st WHERE p1.a <> ''
        UNION ALL SELECT page_id, 'measured_cell_temp_c', p2.b::DOUBLE, 'degC', 'discharge_current_a=' || p2.a::DOUBLE, false, s[:240] FROM st WHERE p2.a <> ''
        UNION ALL SELECT page_id, 'measured_sustained_current_a', p3.a::DOUBLE, 'A', CASE lower(p3.b) WHEN 'one' THEN 'duration_min=1.0' WHEN 'two' THEN 'duration_min=2.0' WHEN 'three' THEN 'duration_min=3.0' ELSE '' END, false, s[:240] FROM st WHERE p3.a <> ''
        UNION ALL SELECT page_id, 'test_discharge_cutoff_v', p4.a::DOUBLE, 'V', '', false, s[:240] FROM st WHERE p4.a <> ''),
    ch AS (SELECT page_id, 'measured_capacity_ah' AS property, regexp_extract(html, '<img src="[^"]*/([^"/]*-Capacity\\.png)"', 1) AS f FROM h
        UNION ALL SELECT page_id, 'measured_energy_wh', regexp_extract(html, '<img src="[^"]*/([^"/]*-Energy\\.png)"', 1) FROM h)"""


def _cases() -> str:
    """The category of a claim as SQL."""
    said = "notes || ' ' || conditions"
    tests = {
        "unit or property": lambda a, b: f"regexp_matches(unit, '{a}') OR regexp_matches(property, '{b}')", "property": lambda a, b: f"regexp_matches(property, '{a}')",
        "property and text": lambda a, b: f"regexp_matches(property, '{a}') AND regexp_matches(conditions, '{b}')", "notes": lambda a, b: f"regexp_matches({said}, '{a}')",
    }
    return "CASE " + " ".join(f"WHEN {tests[where](a, b)} THEN '{name}'" for name, where, a, b in ck.CATEGORIES) + f" ELSE '{ck.OTHER}' END"


ORACLE = {
    "echo_rule_cascade": f"WITH {_ITEMS}, {_LINES}, {sp.entries_sql('lines', 'id')} SELECT * FROM entries",
    "review_measurements": f"""WITH {_REVIEWS} SELECT * FROM ms UNION ALL
        SELECT page_id, property, NULL::DOUBLE, NULL, '', true, 'data presented only as chart image: ' || replace(f, '%20', ' ') FROM ch WHERE f <> ''""",
    "review_echoes": rf"""WITH {_REVIEWS}, e AS (SELECT page_id, regexp_extract(html, '(?is)Official specifications:\s*<ul>(.*?)</ul>', 1) AS u FROM h),
        l AS (SELECT page_id, list_filter([trim(regexp_replace(regexp_replace(i, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) for i in string_split(u, '<li>')[2:]], lambda i: i <> '') AS items FROM e)
        SELECT page_id, array_to_string(items, '|') AS echo, (SELECT count(*) FROM ms WHERE ms.page_id = l.page_id) AS n_stated, (SELECT count(*) FROM ch WHERE ch.page_id = l.page_id AND f <> '') AS n_charts FROM l""",
    "gold_entry_conditions": f"""WITH g AS (SELECT p_brand AS model, 'datasheet_' || l_returnflag AS source_id, {_chosen_sql(["mass_g", "max_charge_voltage_v", "fast_charge_current_a", "cycle_life_cycles"], "l_linenumber")} AS property,
        CASE WHEN l_linestatus = 'F' THEN floor(l_quantity) END AS r, length(CASE l_linenumber % 3 WHEN 0 THEN 'at least' WHEN 1 THEN 'max.' ELSE 'typical' END) + length(l_returnflag) + 3 AS n FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT model, source_id, property, count(*) AS n, count(r) AS with_retention, sum(r)::DOUBLE AS retention, max(n)::INT AS longest FROM g GROUP BY ALL""",
    "policy_parse": r"""WITH st AS (SELECT p_partkey AS id, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_size || '.5' ELSE p_size::VARCHAR END || 'C(' || (p_partkey % 100) || '%)-' || p_size || 'C' AS step FROM part),
        b AS (SELECT id, CASE WHEN id % 7 = 0 THEN '  ' || step || '-newstructure' WHEN id % 11 = 0 THEN '   ' WHEN id % 13 = 0 THEN p_type ELSE step END AS line FROM st UNION ALL SELECT -page_id - 1, url FROM pages),
        p AS (SELECT id, nullif(trim(replace(line, '-newstructure', '')), '') AS policy FROM b), m AS (SELECT *, regexp_extract(policy, '^(\d+(?:\.\d+)?)C\((\d+(?:\.\d+)?)%\)-(\d+(?:\.\d+)?)C$', ['c1', 'soc', 'c2']) AS g FROM p)
        SELECT id, policy, try_cast(g.c1 AS DOUBLE) AS c1, try_cast(g.soc AS DOUBLE) AS soc, try_cast(g.c2 AS DOUBLE) AS c2 FROM m""",
    "answer_scores": rf"""WITH a AS (SELECT conv_id, turn, conv_id % 20 + 1.5::DOUBLE AS g, coalesce(text, '') || CASE turn % 4 WHEN 0 THEN ' It is ' || (conv_id % 20 + 1) || '.5 Ah, see page ' || turn
            WHEN 1 THEN ' About ' || (conv_id % 20 + 1) || ',500 mAh' WHEN 2 THEN ' Perhaps ' || (conv_id % 20 + 1) || '500 Ah' ELSE '' END AS answer FROM conversations),
        n AS (SELECT *, replace(answer, '−', '-') AS t FROM a),
        z AS (SELECT *, list_zip(regexp_extract_all(t, '{tx.ANSWER_NUMBER}', 1), regexp_extract_all(t, '{tx.ANSWER_NUMBER}', 2)) AS pairs FROM n),
        s AS (SELECT *, [{{'n': abs(replace(p[1], ',', '')::DOUBLE), 'u': lower(p[2])}} for p in pairs] AS said FROM z),
        f AS (SELECT *, len(list_filter(said, lambda x: abs(x.n - g) <= 0.02 * greatest(x.n, g, 1e-9))) > 0 AS same,
            list_filter(said, lambda x: abs(x.n - g * 1000) <= 0.02 * greatest(x.n, g * 1000, 1e-9) OR abs(x.n * 1000 - g) <= 0.02 * greatest(x.n * 1000, g, 1e-9)) AS shifted FROM s)
        SELECT conv_id, turn, CASE WHEN len(said) = 0 THEN 'no_value' WHEN same THEN 'correct' WHEN len(shifted) = 0 THEN 'wrong'
            WHEN abs(shifted[1].n - g * 1000) <= 0.02 * greatest(shifted[1].n, g * 1000, 1e-9) AND shifted[1].u IN ('mah', 'ma', 'mv') THEN 'correct' ELSE 'unit_confused' END AS outcome,
            regexp_matches(answer, '{tx.HEDGE.replace(chr(39), chr(39) * 2)}') AS hedged, regexp_matches(answer, '{tx.SOURCE}') AS sourced FROM f""",
    "answers_with_conditions": """WITH a AS (SELECT p_partkey AS k, p_size::DOUBLE AS s, (p_partkey % 60)::DOUBLE AS t,
            CASE p_partkey % 4 WHEN 0 THEN [p_size::DOUBLE, (p_partkey % 60)::DOUBLE] WHEN 1 THEN [p_size * 1000.0::DOUBLE] WHEN 2 THEN []::DOUBLE[] ELSE [p_size + 0.5::DOUBLE] END AS said FROM part),
        g AS (SELECT *, CASE WHEN k % 5 = 0 THEN []::DOUBLE[] WHEN k % 5 < 3 THEN [s] ELSE [s, t] END AS gold FROM a)
        SELECT k AS p_partkey, CASE WHEN len(gold) > 0 THEN len(list_filter(gold, lambda x: len(list_filter(said, lambda a: abs(x - a) <= 0.02 * greatest(x, a, 1e-9) OR abs(x * 1000 - a) <= 0.02 * greatest(x * 1000, a, 1e-9)
            OR (x >= 1000 AND abs(x / 1000 - a) <= 0.02 * greatest(x / 1000, a, 1e-9)))) = 0)) = 0 END AS stated FROM g""",
    "claim_strata": rf"""WITH {_CLAIMS} SELECT doc, CASE WHEN regexp_matches(property, '{ck.GRID}') THEN 'characteristic grid'
        WHEN regexp_matches(notes, '(?i)graph') OR regexp_matches(conditions, '(?i)graph') THEN 'read from graph' ELSE 'specification row' END AS stratum, count(*) AS n FROM c GROUP BY ALL""",
    "claim_categories": f"WITH {_CLAIMS} SELECT property, {_cases()} AS category, count(*) AS n FROM c GROUP BY ALL",
    "claim_precedents": f"""WITH {_CLAIMS}, k AS (SELECT *, {_cases()} AS category FROM c), p AS (SELECT category, doc, count(*) AS n FROM k GROUP BY ALL)
        SELECT category, sum(n)::BIGINT AS n, count(*) AS n_docs_with, string_agg(doc || '=' || n, ',' ORDER BY doc || '=' || n) AS documents,
               (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM (SELECT id FROM k WHERE k.category = p.category ORDER BY id LIMIT 3)) AS examples FROM p GROUP BY category""",
    "file_fields": rf"""WITH b AS (SELECT p_partkey AS id, 'SNL_18650_LFP_' || p_size || 'C_' || (p_partkey % 50) || '-100_0.' || p_size || '-' || (p_partkey % 4) || '.0C_r' || p_size || CASE WHEN p_partkey % 6 = 0 THEN '_timeseries.csv' ELSE '_cycle_data.csv' END AS name FROM part
        UNION ALL SELECT -page_id - 1, string_split(url, '/')[-1] FROM pages), m AS (SELECT id, regexp_extract(name, '{ck.FILE_NAME}', ['a', 'b', 'c', 'd', 'e']) AS g FROM b)
        SELECT id, try_cast(g.a AS DOUBLE) AS temperature_c, CASE WHEN g.a <> '' THEN g.b || '%' END AS dod_window, CASE WHEN g.a <> '' THEN regexp_replace(try_cast(g.c AS DOUBLE)::VARCHAR, '\.0$', '') || 'C' END AS c_rate_charge,
               CASE WHEN g.a <> '' THEN regexp_replace(try_cast(g.d AS DOUBLE)::VARCHAR, '\.0$', '') || 'C' END AS c_rate_discharge, nullif(g.e, '') AS replicate FROM m""",
}
