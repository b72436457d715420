"""Queries over text: pages as reviews, conversations as answers, documents as sources of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.functions import values as vl
from attestor.operators import claims, matching, passages
from attestor.plans.common import rounded, table


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every page, as digest and length."""
    return table(spark, folder, "pages").select("page_id", F.md5(tx.html_text(F.col("html"))).alias("digest"), F.char_length(tx.html_text(F.col("html"))).alias("n"))


def html_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """How many sentences a page has and how long they are together."""
    s = table(spark, folder, "pages").select("page_id", tx.sentences(tx.html_text(F.col("html"))).alias("s"))
    return s.select("page_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def spec_echo_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The items of the lists of every page."""
    return table(spark, folder, "pages").select("page_id", F.posexplode(tx.list_items(F.col("html"))).alias("pos", "line"))


def review_parts(spark: SparkSession, folder: str) -> DataFrame:
    """List items per page and their mean length, the shape of a parsed review."""
    items = table(spark, folder, "pages").select("page_id", tx.list_items(F.col("html")).alias("i"))
    return items.select("page_id", F.size("i").cast("long").alias("n"), F.char_length(F.array_join("i", "")).alias("chars"))


def doc_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The numbers of every document, thousands separators removed."""
    d = table(spark, folder, "documents").select("doc_id", tx.numbers(F.col("text")).alias("x"))
    return d.select("doc_id", F.size("x").cast("long").alias("n"), F.array_min("x").alias("least"), F.array_max("x").alias("most"), F.size(F.array_distinct("x")).cast("long").alias("different"))


def value_in_source(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents hold the claimed values 50, 3.35 or 1999 in some scale."""
    d = table(spark, folder, "documents").select("doc_id", tx.numbers(F.col("text")).alias("x"))
    out = d.select("doc_id", *[F.coalesce(vl.in_numbers(F.lit(v), F.col("x")), F.lit(False)).alias(n) for n, v in (("fifty", 50.0), ("small", 3.35), ("large", 1999.0))])
    return out


def schema_gate(spark: SparkSession, folder: str) -> DataFrame:
    """What claims a raw value holds, over values made from vectors."""
    e = table(spark, folder, "embeddings").withColumn("v", F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x.cast("double") * 100).cast("string")))
    at = lambda i: F.col("v")[i]
    raw = (
        F.when(F.col("vec_id") % 6 == 0, at(0)).when(F.col("vec_id") % 6 == 1, F.concat(F.lit("["), at(0), F.lit(","), at(1), F.lit("]")))
        .when(F.col("vec_id") % 6 == 2, F.concat(F.lit("["), F.array_join("v", ","), F.lit("]"))).when(F.col("vec_id") % 6 == 3, F.concat(F.lit("[["), at(0), F.lit(","), at(1), F.lit("],["), at(2), F.lit(","), at(3), F.lit("]]")))
        .when(F.col("vec_id") % 6 == 4, F.lit('"text"'))
    )
    out = e.select("vec_id", claims.unnested(raw).alias("p"))
    return out.select("vec_id", F.size(F.coalesce("p", F.array().cast("array<array<double>>"))).alias("n"), F.aggregate(F.flatten("p"), F.lit(0.0), lambda a, x: a + x).alias("total"))


def unit_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose quantity as mass in grams, and price in mA, is plausible."""
    b = claims.bounds_table(spark)
    l = table(spark, folder, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "mass_g").when(F.col("l_linenumber") % 3 == 0, "max_charge_current_a").otherwise("unknown").alias("property"), "l_quantity", "l_extendedprice")
    v = F.when(F.col("property") == "max_charge_current_a", F.col("l_extendedprice") * 0.001).otherwise(F.col("l_quantity"))
    return l.join(F.broadcast(b), "property", "left").groupBy("property").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lo").isNull() | v.between(F.col("lo"), F.col("hi"))).alias("sane"))


def tolerance_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges that a text states as X ± Y, over parts' sizes."""
    p = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), ((F.col("p_partkey") % 3) + 1).cast("double").alias("y"))
    text = F.concat(F.lit("size "), F.col("x").cast("int").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " ± ").otherwise(" +/- "), F.when(F.col("p_partkey") % 5 == 0, "9").otherwise(F.col("y").cast("int").cast("string")))
    rows = p.select("p_partkey", F.array(F.col("x") - F.col("y"), F.col("x") + F.col("y")).alias("v"), tx.plus_minus(text).alias("pm"))
    out = claims.with_tolerance(rows, "v", "pm")
    return rounded(out.select("p_partkey", "normalized", F.size("v").alias("arity"), F.col("v")[0].alias("first")))


def validate_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims made from each document's own numbers, a shifted one, a malformed one and an implausible one, by outcome."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text", tx.numbers(F.col("text")).alias("x"))
    first = F.abs(F.get("x", F.lit(0)))
    claim = lambda p, v, u: F.struct(F.lit(p).alias("property"), v.cast("string").alias("value"), F.lit(u).alias("unit"))
    many = F.array(claim("cycle_life_cycles", F.format_string("%.0f", first), "cycles"), claim("unknown", F.lit("[12345.678, 1.5, 2.25]"), "V"), claim("mass_g", F.lit('"heavy"'), "g"), claim("mass_g", F.lit(None), "g"))
    out = claims.validated(d.select("doc", F.inline(many)), d, "doc", "text")
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def policy_group_id(spark: SparkSession, folder: str) -> DataFrame:
    """Dense group numbers of brands in sorted order."""
    p = table(spark, folder, "part")
    groups = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return groups.select("p_brand", "n", F.concat(F.lit("pg"), F.lpad((F.dense_rank().over(Window.orderBy("p_brand")) - 1).cast("string"), 3, "0")).alias("group_id"))


def name_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that a URL's parts encode."""
    u = F.col("url")
    pattern = r"^(https?)://([^/]+)/([a-z]{2})/(\d+)(.*)$"
    part = lambda k: F.regexp_extract(u, pattern, k)
    return table(spark, folder, "pages").where(u.rlike(pattern)).select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("lang"), part(4).cast("int").alias("number"))


def source_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Identity of every document: a number as preprint id where divisible by seven, else its text's hash."""
    arxiv = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select("doc_id", tx.source_key(F.lit(None).cast("string"), arxiv, F.col("text")).alias("key"))


def triage_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions of replies; two of three turns are given a verdict before their text."""
    c = table(spark, folder, "conversations")
    reply = F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" Maybe: "), "text")).when(F.col("turn") % 3 == 2, F.concat(F.lit("NO - "), "text")).otherwise(F.col("text"))
    out = c.select(tx.triage(reply).alias("t"))
    return out.groupBy("t.decision").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("t.rationale").cast("long")).alias("chars"))


def hedging(spark: SparkSession, folder: str) -> DataFrame:
    """Hedges, sources and question marks by role."""
    c = table(spark, folder, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.hedges(F.col("text"))).alias("hedged"), F.count_if(tx.names_source(F.col("text"))).alias("sourced"), F.count_if(F.col("text").contains("?")).alias("asks"))


def page_context(spark: SparkSession, folder: str) -> DataFrame:
    """A turn's text, with its neighbours' where it is short."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, folder, "conversations")
    short = F.char_length(F.regexp_replace("text", r"\s", "")) < 100
    wide = F.concat_ws("\n", F.lag("text").over(w), "text", F.lead("text").over(w))
    return c.select("conv_id", "turn", short.alias("short"), F.md5(F.when(short, wide).otherwise(F.col("text"))).alias("digest"))


def field_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Majority of a field (length class, one of them in two spellings) over the turns of a conversation as runs."""
    c, n = table(spark, folder, "conversations"), F.char_length("text")
    value = F.when(n % 5 == 0, "Unspecified").when(n % 4 == 0, "1 A").when(n % 2 == 0, "1.0 A").otherwise("odd")
    return matching.field_majority(c.select("conv_id", F.col("turn").alias("run"), F.col("role").alias("field"), value.alias("value")), ["conv_id"])


def stitched_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Turns joined with the next one by the rule for tables torn by a page break."""
    n = F.char_length("text")
    r = table(spark, folder, "conversations").select("conv_id", "turn", (n % 2).alias("n_cols"), (n % 3 + F.lit(1)).cast("int").alias("q"), (n % 7 == 0).alias("has_free"))
    return matching.stitched(r.select("conv_id", "turn", "n_cols", F.when(F.col("q") == 3, 2).otherwise(1).alias("n_quantity"), "has_free"), "conv_id", "turn")


def categorise(spark: SparkSession, folder: str) -> DataFrame:
    """The first category that a document's text meets, and how often."""
    t = F.col("text")
    kind = F.when(t.rlike("(?i)license|copyright"), "legal").when(t.rlike("@[a-z0-9.]+"), "contact").when(t.rlike(r"\d"), "numeric").when(t.rlike(r"\|"), "table").otherwise("prose")
    return table(spark, folder, "documents").groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def strata(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows and good ones in three strata of length."""
    d = table(spark, folder, "documents").select("doc_id", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long").alias("stratum"))
    return table(spark, folder, "labels").join(d, "doc_id").groupBy("stratum").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("matched"))


def value_location(spark: SparkSession, folder: str) -> DataFrame:
    """In which documents each benchmark passage is found, white space and commas aside."""
    squash = lambda c: F.regexp_replace(c, r"[\s,]", "")
    items = table(spark, folder, "benchmark").select("item_id", squash(F.col("text")).alias("item"))
    d = table(spark, folder, "documents").select("doc_id", squash(F.col("text")).alias("body"))
    found = passages.found(d, "body", "doc_id", items, "item", "item_id")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def json_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in JSON payloads, and the block that a reply around them holds."""
    e = table(spark, folder, "events")
    reply = F.concat(F.lit("```json\nHere: "), "props", F.lit(" done\n```"))
    block = tx.json_block(reply, "{", "}")
    k = F.from_json(block, "k double")["k"]
    return rounded(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("parsed"), F.sum(k).alias("total")))


def query_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of recorded queries by text and sorted parameters."""
    n = table(spark, folder, "nation")
    params = F.create_map(F.lit("view"), F.col("n_name"), F.lit("k"), F.col("n_nationkey").cast("string"))
    return n.select("n_nationkey", tx.query_key(F.concat(F.lit("MATCH  (a)\n  RETURN "), "n_name"), params).alias("key"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """A question for each part, qualified by its type where a brand has several of a size."""
    p = table(spark, folder, "part")
    several = F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_size")) > 1
    return p.select("p_partkey", F.concat(F.lit("What is the price of "), "p_brand", F.lit(" "), F.col("p_size").cast("string"), F.when(several, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise(""), F.lit("?")).alias("question"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Used but undefined and defined but unused names: both ways empty means the vocabulary fits."""
    used = table(spark, folder, "part").select(F.col("p_brand").alias("w")).distinct()
    defined = spark.range(1, 26).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("w"))
    return used.exceptAll(defined).select("w", F.lit("undefined").alias("problem")).unionByName(defined.exceptAll(used).select("w", F.lit("unused").alias("problem")))


def quantity_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Table-like lines of documents (with bars) and how many of their cells are bare quantities."""
    line = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains("|"))
    cells = line.withColumn("cells", F.transform(F.split("line", r"\|"), lambda c: F.trim(c)))
    return cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("cells").cast("long")).alias("cells"), F.sum(F.size(F.filter("cells", tx.is_quantity)).cast("long")).alias("quantities"))


def stage_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates (texts) staged once each: the first document of every key, all pending."""
    keyed = table(spark, folder, "documents").select("doc_id", tx.squashed_key(F.col("text")).alias("candidate_id"))
    return keyed.groupBy("candidate_id").agg(F.min("doc_id").alias("doc_id")).withColumn("status", F.lit("pending_review"))


QUERIES = {f.__name__: f for f in (
    html_text, html_sentences, spec_echo_lines, review_parts, doc_numbers, value_in_source, schema_gate, unit_bounds, tolerance_normalize, validate_claims,
    policy_group_id, name_fields, source_keys, triage_parse, hedging, page_context, field_consensus, stitched_regions, categorise, strata,
    value_location, json_numbers, query_keys, questions, vocabulary, quantity_cells, stage_candidates,
)}

_HTML = r"regexp_replace(regexp_replace(regexp_replace(html, '<img[^>]*>', ' ', 'g'), '<[^>]+>', chr(10), 'g'), '[ \t]+', ' ', 'g')"
_ITEMS = r"""items AS (SELECT page_id, i - 2 AS pos, trim(regexp_replace(regexp_replace(regexp_replace(parts[i], '(?is)</(?:li|ul|ol)>.*$', ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS line
    FROM (SELECT page_id, regexp_split_to_array(html, '(?i)<li[^>]*>') AS parts FROM pages), range(2, len(parts) + 1) t(i))"""
_NUMS = r"""nums AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(replace(text, '−', '-'), '(\d),(\d{3})\b', '\1\2', 'g'), '(\d),(\d{3})\b', '\1\2', 'g'), '-?\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS x FROM documents)"""
_WS = r"regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')"


def _near(v: float) -> str:
    scaled = [v] + ([v * 1000] if v < 100 else []) + ([v / 1000] if v >= 1000 else [])
    return "len(list_filter(x, lambda d: " + " OR ".join(f"abs({s} - abs(d)) <= 0.02 * greatest({s}, abs(d), 1e-9)" for s in scaled) + ")) > 0"


_KEY = "concat('title:', substring(sha1(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')), 1, 16))"
ORACLE = {
    "html_text": f"SELECT page_id, md5({_HTML}) AS digest, length({_HTML})::INT AS n FROM pages",
    "html_sentences": rf"""WITH s AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace({_HTML}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: {_WS}), lambda x: x <> '') AS s FROM pages)
        SELECT page_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s""",
    "spec_echo_lines": f"WITH {_ITEMS} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INT AS pos, line FROM items WHERE line <> ''",
    "review_parts": f"WITH {_ITEMS} SELECT p.page_id, count(line) FILTER (line <> '') AS n, coalesce(sum(length(line)), 0)::INT AS chars FROM pages p LEFT JOIN items i ON i.page_id = p.page_id GROUP BY p.page_id",
    "doc_numbers": f"WITH {_NUMS} SELECT doc_id, len(x) AS n, list_min(x) AS least, list_max(x) AS most, len(list_distinct(x)) AS different FROM nums",
    "value_in_source": f"WITH {_NUMS} SELECT doc_id, {_near(50.0)} AS fifty, {_near(3.35)} AS small, {_near(1999.0)} AS large FROM nums",
    "schema_gate": """WITH e AS (SELECT vec_id, vec_id % 6 AS k, [floor(embedding[i]::DOUBLE * 100) for i in [1, 2, 3, 4]] AS v FROM embeddings)
        SELECT vec_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 0 END AS n, CASE k WHEN 0 THEN v[1] WHEN 1 THEN v[1] + v[2] WHEN 2 THEN list_sum(v) WHEN 3 THEN list_sum(v) ELSE 0 END AS total FROM e""",
    "unit_bounds": """WITH l AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'mass_g' WHEN l_linenumber % 3 = 0 THEN 'max_charge_current_a' ELSE 'unknown' END AS property, l_quantity, l_extendedprice FROM lineitem)
        SELECT property, count(*) AS n, count(*) FILTER (CASE property WHEN 'mass_g' THEN l_quantity BETWEEN 10 AND 100 WHEN 'max_charge_current_a' THEN l_extendedprice * 0.001::DOUBLE BETWEEN 0.01 AND 100 ELSE true END) AS sane FROM l GROUP BY 1""",
    "tolerance_normalize": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 3 + 1)::DOUBLE AS y, CASE WHEN p_partkey % 5 = 0 THEN 9.0 ELSE p_partkey % 3 + 1 END AS s FROM part),
        n AS (SELECT *, abs(y - s) <= 0.05 * greatest(y, s) AS normalized FROM p)
        SELECT p_partkey, normalized, CASE WHEN normalized THEN 1 ELSE 2 END AS arity, round(CASE WHEN normalized THEN x ELSE x - y END, 6) AS first FROM n""",
    "policy_group_id": "SELECT p_brand, count(*) AS n, 'pg' || lpad((dense_rank() OVER (ORDER BY p_brand) - 1)::VARCHAR, 3, '0') AS group_id FROM part GROUP BY p_brand",
    "name_fields": r"""WITH m AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/(\d+)(.*)$', ['scheme', 'host', 'lang', 'number', 'rest']) AS g FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/([a-z]{2})/(\d+)(.*)$'))
        SELECT page_id, g.scheme, g.host, g.lang, g.number::INT AS number FROM m""",
    "source_keys": f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'arxiv:' || doc_id ELSE {_KEY} END AS key FROM documents",
    "triage_parse": r"""WITH r AS (SELECT regexp_replace(CASE WHEN turn % 3 = 1 THEN ' Maybe: ' || text WHEN turn % 3 = 2 THEN 'NO - ' || text ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM conversations),
        d AS (SELECT t, regexp_matches(t, '(?is)^\s*(yes|maybe|no)\s*[:\-–]\s*(.+)$') AS known FROM r),
        o AS (SELECT CASE WHEN known THEN lower(regexp_extract(t, '(?is)^\s*(yes|maybe|no)\s*[:\-–]\s*(.+)$', 1)) ELSE 'unparsed' END AS decision,
            CASE WHEN known THEN substring(trim(regexp_replace(regexp_extract(t, '(?is)^\s*(yes|maybe|no)\s*[:\-–]\s*(.+)$', 2), '\s+', ' ', 'g')), 1, 300) ELSE substring(t, 1, 200) END AS rationale FROM d)
        SELECT decision, count(*) AS n, sum(length(rationale))::BIGINT AS chars FROM o GROUP BY 1""",
    "hedging": r"""SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)(not (entirely |completely )?certain|I don''?t know|cannot confirm|unsure|uncertain|may vary|approximately|not specified)')) AS hedged,
        count(*) FILTER (regexp_matches(text, '(?i)(p\.\s*\d+|page \d+|https?://|doi\.org|product specification)')) AS sourced, count(*) FILTER (contains(text, '?')) AS asks FROM conversations GROUP BY 1""",
    "page_context": r"""WITH c AS (SELECT *, lag(text) OVER w AS a, lead(text) OVER w AS b, length(regexp_replace(text, '\s', '', 'g')) < 100 AS short FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, short, md5(CASE WHEN short THEN concat_ws(chr(10), a, text, b) ELSE text END) AS digest FROM c""",
    "field_consensus": """WITH f AS (SELECT conv_id, turn, role AS field, length(text) AS n FROM conversations),
        c AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, CASE WHEN n % 4 = 0 THEN '1 A' WHEN n % 2 = 0 THEN '1.0 A' ELSE 'odd' END AS value FROM f WHERE n % 5 <> 0),
        v AS (SELECT conv_id, field, kind, arg_min(value, turn) AS value, count(*) AS n, min(turn) AS first FROM c GROUP BY 1, 2, 3)
        SELECT conv_id, field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, field ORDER BY n DESC, first) AS k FROM v) WHERE k = 1 AND n >= 2""",
    "categorise": r"""SELECT CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 'legal' WHEN regexp_matches(text, '@[a-z0-9.]+') THEN 'contact' WHEN regexp_matches(text, '\d') THEN 'numeric'
        WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS category, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1""",
    "strata": """SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS stratum, count(*) AS total, count(*) FILTER (quality = 1) AS matched
        FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "value_location": r"""WITH i AS (SELECT item_id, regexp_replace(text, '[\s,]', '', 'g') AS item FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '[\s,]', '', 'g') AS body FROM documents)
        SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM i JOIN d ON contains(body, item) WHERE length(item) > 0 GROUP BY 1""",
    "json_numbers": "SELECT event_type, count(*) AS n, count((props->>'k')::DOUBLE) AS parsed, round(sum((props->>'k')::DOUBLE), 6) AS total FROM events GROUP BY 1",
    "query_keys": """SELECT n_nationkey, 'MATCH (a) RETURN ' || n_name || '|{"k": ' || n_nationkey || ', "view": ' || n_name || '}' AS key FROM nation""",
    "questions": """SELECT p_partkey, 'What is the price of ' || p_brand || ' ' || p_size || CASE WHEN count(*) OVER (PARTITION BY p_brand, p_size) > 1 THEN ' (' || p_type || ')' ELSE '' END || '?' AS question FROM part""",
    "vocabulary": """WITH u AS (SELECT DISTINCT p_brand AS w FROM part), d AS (SELECT 'Brand#' || i AS w FROM range(1, 26) t(i))
        SELECT w, 'undefined' AS problem FROM (SELECT w FROM u EXCEPT SELECT w FROM d) UNION ALL SELECT w, 'unused' FROM (SELECT w FROM d EXCEPT SELECT w FROM u)""",
    "quantity_cells": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(line, '|')] AS cells FROM l WHERE contains(line, '|'))
        SELECT doc_id, count(*) AS rows, sum(len(cells))::BIGINT AS cells,
               sum(len(list_filter(cells, lambda x: regexp_matches(x, '(?i)^[-−~]?\s*\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:%|℃|°C|mAh|Ah|mA|A|mV|V|mΩ|mOhm|cycles?|g|mm|min|h)?$'))))::BIGINT AS quantities FROM c GROUP BY 1""",
    "stage_candidates": f"SELECT {_KEY} AS candidate_id, min(doc_id) AS doc_id, 'pending_review' AS status FROM documents GROUP BY 1",
}
