"""Queries over what readers, stores and streams make of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions import text as tx
from attestor.functions import values as vl
from attestor.operators import answers
from attestor.plans.common import rounded, table
from attestor.sources import cycles, feeds
from attestor.storage import shared_root
from attestor.streaming import candidates


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/attestor/{name}-{uuid.uuid4().hex}"


def decoded_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Names read back from arrays of character codes with zeros among them."""
    codes = F.concat(F.array(F.lit(0)), F.transform(F.split("p_name", ""), lambda c: F.ascii(c)), F.array(F.lit(0), F.lit(0)))
    return table(spark, folder, "part").select("p_partkey", codes.alias("codes")).select("p_partkey", cycles.decoded("codes").alias("name"))


def truncated_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Curves of different lengths cut to the shorter one."""
    e = table(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", F.lit(3), (F.col("vec_id") % 12 + 1).cast("int")).alias("b"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 5)
    return e.select("vec_id", *cycles.truncated("a", "b")).select("vec_id", F.size("a").alias("n"), F.size("b").alias("m"), total("a").alias("total_a"), total("b").alias("total_b"))


def claim_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of a JSON document for each brand, with their positions, ids and conditions."""
    p = table(spark, folder, "part")
    claim = F.struct(
        F.col("p_partkey").alias("order"), F.when(F.col("p_partkey") % 3 == 0, "mass_g").otherwise("height_mm").alias("property"), F.col("p_size").cast("string").alias("value"), F.lit("g").alias("unit"),
        (F.col("p_partkey") % 9).cast("int").alias("page"), F.create_map(F.lit("text"), F.col("p_type"), F.lit("rate"), (F.col("p_size") * 2).cast("string")).alias("stated_conditions"),
    )
    docs = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(claim), lambda x, y: F.when(x["order"] < y["order"], -1).otherwise(1)).alias("claims")).select("p_brand", F.to_json(F.struct(F.col("p_brand").alias("cell_model"), "claims")).alias("body"))
    out = feeds.claim_documents(docs, "p_brand", "body")
    return out.select("doc", "pos", "claim_id", "property", "value", "page", "conditions_text", F.element_at("conditions", "rate").alias("rate"))


def atom_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of Atom feeds, each with the entries of up to five hundred documents, those of 2024 and later."""
    d, at = table(spark, folder, "documents"), _fresh(spark, "atom")
    entry = F.format_string("<entry><id>http://arxiv.org/abs/%d.5</id><title> Paper\n%d</title><published>%d-01-02T00:00:00Z</published><summary> About %d </summary><author><name>A %d</name></author></entry>", "doc_id", F.col("doc_id") % 50, 2020 + F.col("doc_id") % 8, "doc_id", "doc_id")
    pages = d.where("doc_id is not null").groupBy(F.floor(F.col("doc_id") / 500).alias("page")).agg(F.array_join(F.collect_list(entry), "").alias("entries"))
    pages.select("page", F.concat(F.lit("<feed>"), "entries", F.lit("</feed>")).alias("value")).repartition("page").write.partitionBy("page").text(at)
    return feeds.atom_entries(spark, at).select("candidate_id", "title", F.size("authors").alias("authors"), "year", "abstract")


def first_percentages(spark: SparkSession, folder: str) -> DataFrame:
    """The first percentage of every document, and of a sentence about it."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" until "), (F.col("doc_id") % 100).cast("string"), F.lit(".5 % are left, 3%"))
    return table(spark, folder, "documents").select("doc_id", tx.first_percent(F.col("text")).alias("stated"), tx.first_percent(said).alias("with_sentence"))


def matched_values(spark: SparkSession, folder: str) -> DataFrame:
    """Whether two statements of a part's size agree across units, order and arity, by brand."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    a = F.when(k % 3 == 0, F.array(size, size * 2)).otherwise(F.array(size))
    b = F.when(k % 3 == 0, F.array(size * 2000, size * 1000)).when(k % 3 == 1, F.array(size * 1010)).when(k % 6 == 2, F.array(size * 1030)).otherwise(F.array().cast("array<double>"))
    match = vl.values_match(a, F.lit("Ah"), b, F.lit("mAh"))
    return table(spark, folder, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(match).alias("matched"))


def marked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a document for each conversation, its turns behind page marks."""
    turn = F.concat(F.lit("=== PAGE "), F.col("turn").cast("string"), F.lit(" ==="), F.coalesce("text", F.lit("")))
    docs = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "").alias("body"))
    return feeds.pages_of(docs, "conv_id", "body").select("conv_id", "page", F.md5("text").alias("digest"))


def finite_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values by brand of which some are not finite and count as missing."""
    k = F.col("p_partkey")
    v = F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("inf")).when(k % 11 == 0, float("-inf")).otherwise(F.col("p_size").cast("double"))
    f = vl.finite(v)
    return table(spark, folder, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count(f).alias("finite"), F.sum(f).alias("total"))


def staged_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents staged as candidates in three batches, one of them twice, and two promoted, by batch and status."""
    d = table(spark, folder, "documents").where("doc_id is not null").select(F.concat(F.lit("c"), (F.col("doc_id") % 200).cast("string")).alias("candidate_id"), F.col("lang").alias("title"), (F.col("doc_id") % 3).alias("batch"))
    store = candidates.CandidateStore(spark, _fresh(spark, "candidates"), T.StructType.fromDDL("candidate_id string, title string"))
    for number in (0, 1, 2, 1):  # the last one runs again, as after a failure
        store.stage(d.where(F.col("batch") == number).select("candidate_id", "title"), number)
    for one in ("c1", "c7"):
        store.promote(one, confirm=True)
    pending = store.pending().select(F.col("candidate_id").alias("p"))
    return store.staged().join(pending, F.col("candidate_id") == F.col("p"), "left").groupBy("batch", "status").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("pending"))


def _streamed(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The complete result of a stream over all that is there, stored by its last batch."""
    at = _fresh(spark, name)
    write = lambda rows, _: rows.write.mode("overwrite").parquet(at)
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at)


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type, counted as a stream."""
    out = _run(spark, candidates.windowed_counts(_streamed(spark, folder), "ts", "1 day", "1 day", ["event_type"]), "windows")
    return out.select(F.unix_seconds("window.start").alias("day"), "event_type", "n")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users without a gap of a day, found as a stream."""
    out = _run(spark, candidates.sessions(_streamed(spark, folder), "ts", "1 day", "1 day", ["user_id"]), "sessions")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("most"), F.min(F.unix_micros("session_window.start")).alias("first"))


def recorded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to a query about two nations, recorded once and asked again without their source."""
    shelf = answers.Recorded(spark, _fresh(spark, "answers"))
    query, n = "MATCH (n)  RETURN n", table(spark, folder, "nation").join(table(spark, folder, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    for k in (1, 2):
        shelf.run(query, {"k": str(k)}, lambda: spark.range(1)).count()
        shelf.record(query, {"k": str(k)}, n.where(F.col("n_nationkey") == k).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers")))
    return shelf.run("MATCH (n) RETURN\n n", {"k": "1"}).unionByName(shelf.run(query, {"k": "2"}))


def reply_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of replies of a model: fenced lists, lists among words, none at all, and claims without their fields."""
    k = F.col("p_partkey")
    one = F.format_string('{"property": "mass_g", "value": %d, "unit": "g", "stated_conditions": {"rate": "%d"}}', "p_size", k)
    reply = F.when(k % 5 == 0, F.concat(F.lit("```json\n["), one, F.lit(", "), one, F.lit("]\n```"))).when(k % 5 == 1, F.concat(F.lit("Here: ["), one, F.lit("] done"))).when(k % 5 == 2, "I found none").when(k % 5 == 3, '[{"property": "mass_g", "unit": "g"}]').otherwise('[{"value": 3}, 5')
    out = feeds.reply_claims(table(spark, folder, "part").select("p_partkey", reply.alias("reply")), "reply")
    return out.groupBy("parse_error", "error").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("replies"), F.sum(F.col("value").cast("long")).alias("total"))


QUERIES = {f.__name__: f for f in (
    decoded_codes, truncated_curves, claim_documents, atom_feed, first_percentages, matched_values, marked_pages, finite_values, staged_candidates, stream_windows, stream_sessions, recorded_answers, reply_claims,
)}

ORACLE = {
    "decoded_codes": "SELECT p_partkey, p_name AS name FROM part",
    "truncated_curves": """WITH e AS (SELECT vec_id, embedding[1:8] AS a, embedding[3:(2 + vec_id % 12 + 1)::INT] AS b FROM embeddings), t AS (SELECT *, least(len(a), len(b)) AS n FROM e)
        SELECT vec_id, n::INT AS n, n::INT AS m, round(coalesce(list_sum([x::DOUBLE for x in a[1:n]]), 0), 5) AS total_a, round(coalesce(list_sum([x::DOUBLE for x in b[1:n]]), 0), 5) AS total_b FROM t""",
    "claim_documents": """WITH c AS (SELECT p_brand AS doc, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'mass_g' ELSE 'height_mm' END AS property, p_size::VARCHAR AS value, (p_partkey % 9)::INT AS page, p_type AS conditions_text, (p_size * 2)::VARCHAR AS rate FROM part)
        SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY p_partkey))::INT AS pos, doc || ':' || property || ':' || (row_number() OVER (PARTITION BY doc, property ORDER BY p_partkey) - 1) AS claim_id, property, value, page, conditions_text, rate FROM c""",
    "atom_feed": """SELECT 'arxiv:' || doc_id || '.5' AS candidate_id, 'Paper ' || (doc_id % 50) AS title, 1 AS authors, (2020 + doc_id % 8)::INT AS year, 'About ' || doc_id AS abstract FROM documents WHERE doc_id IS NOT NULL AND 2020 + doc_id % 8 >= 2024""",
    "first_percentages": r"""WITH d AS (SELECT doc_id, text, coalesce(text, '') || ' until ' || (doc_id % 100) || '.5 % are left, 3%' AS said FROM documents)
        SELECT doc_id, try_cast(nullif(regexp_extract(text, '(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE) AS stated, try_cast(nullif(regexp_extract(said, '(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE) AS with_sentence FROM d""",
    "matched_values": "SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey % 3 < 2) AS matched FROM part GROUP BY 1",
    "marked_pages": "SELECT conv_id, turn::INT AS page, md5(coalesce(text, '')) AS digest FROM conversations",
    "finite_values": "SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0) AS finite, sum(p_size) FILTER (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)::DOUBLE AS total FROM part GROUP BY 1",
    "staged_candidates": """WITH c AS (SELECT doc_id % 200 AS c, min(doc_id % 3) AS batch FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
        SELECT batch, CASE WHEN c IN (1, 7) THEN 'promoted' ELSE 'pending_review' END AS status, count(*) AS n, count(*) FILTER (c NOT IN (1, 7)) AS pending FROM c GROUP BY 1, 2""",
    "stream_windows": "SELECT floor(epoch_us(ts) / 86400000000)::BIGINT * 86400 AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 86400000000 AS new FROM events),
        r AS (SELECT user_id, t, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM g), s AS (SELECT user_id, run, count(*) AS n, min(t) AS t FROM r GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS most, min(t) AS first FROM s GROUP BY 1""",
    "recorded_answers": "SELECT n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey IN (1, 2) GROUP BY 1",
    "reply_claims": """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_size FROM part)
        SELECT k IN (2, 4) AS parse_error, CASE WHEN k = 2 THEN 'no_list' WHEN k = 4 THEN 'no_list' WHEN k = 3 THEN 'missing: value' END AS error, sum(CASE WHEN k = 0 THEN 2 ELSE 1 END)::BIGINT AS n, count(*) AS replies,
               sum(CASE WHEN k = 0 THEN 2 * p_size WHEN k = 1 THEN p_size END)::BIGINT AS total FROM p GROUP BY 1, 2""",
}
