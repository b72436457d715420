"""Readers of what arrives from outside: paper feeds (JSON and Atom), claim documents, model replies.

All take a DataFrame of raw texts (or paths) and return rows; nothing here talks to a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import text as tx

# Papers before this year are left out; at most so many authors and characters of abstract are kept; the fields
# that a claim can't do without.
REQUIRED = ("property", "value", "unit")
FIRST_YEAR, AUTHORS, ABSTRACT = 2024, 12, 1500
SEARCH = "struct<total:int,data:array<struct<title:string,year:int,venue:string,externalIds:struct<DOI:string,ArXiv:string>,abstract:string,authors:array<struct<name:string>>>>>"
ATOM = "id string, title string, published string, summary string, author array<struct<name:string>>"
CLAIMS = (
    "struct<cell_model:string,manufacturer:string,source_document:string,source_url:string,retrieved:string,"
    "claims:array<struct<property:string,value:string,unit:string,page:int,stated_conditions:map<string,string>,notes:string>>,"
    "omissions:array<struct<property:string,note:string>>>"
)


def _candidate(title: Column, authors: Column, venue: Column, year: Column, doi: Column, arxiv: Column, abstract: Column, api: str) -> list[Column]:
    return [
        tx.source_key(doi, arxiv, title).alias("candidate_id"), title.alias("title"), F.slice(authors, 1, AUTHORS).alias("authors"), F.coalesce(venue, F.lit("")).alias("venue"),
        year.alias("year"), doi.alias("doi"), arxiv.alias("arxiv_id"), F.substring(F.coalesce(abstract, F.lit("")), 1, ABSTRACT).alias("abstract"), F.lit(api).alias("api"),
    ]


def search_results(pages: DataFrame, payload: str) -> DataFrame:
    """Candidates of JSON search pages; entries without a title or before ``FIRST_YEAR`` go, broken pages give none."""
    p = pages.select(F.explode(F.from_json(payload, SEARCH)["data"]).alias("p")).where((F.col("p.year") >= FIRST_YEAR) & (F.coalesce("p.title", F.lit("")) != ""))
    c = F.col
    return p.select(*_candidate(c("p.title"), F.transform(F.coalesce("p.authors", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]), c("p.venue"), c("p.year"), c("p.externalIds.DOI"), c("p.externalIds.ArXiv"), c("p.abstract"), "search"))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of Atom feeds at ``path``, read with Spark's XML source by entry."""
    e = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(ATOM).load(path)
    title = F.replace(F.trim("title"), F.lit("\n"), F.lit(" "))
    year = F.regexp_extract("published", r"^(\d{4})", 1).try_cast("int")
    number = F.when(F.col("id").contains("/abs/"), F.element_at(F.split("id", "/abs/"), -1)).otherwise(F.col("id"))
    none = F.lit(None).cast("string")
    rows = e.select(*_candidate(title, F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]), F.lit("arXiv"), year, none, number, F.trim("summary"), "atom"))
    return rows.where((F.col("year") >= FIRST_YEAR) & (F.coalesce("title", F.lit("")) != ""))


def claim_documents(docs: DataFrame, name: str, body: str) -> DataFrame:
    """(doc, cell_model, pos, claim_id, property, value, unit, page, conditions_text, conditions, notes) of JSON claim documents.

    ``pos`` counts from 1 in the document, ``claim_id`` numbers equal properties of a document from 0.
    """
    d = docs.select(F.col(name).alias("doc"), F.from_json(body, CLAIMS).alias("d"))
    rows = d.select("doc", "d.cell_model", F.posexplode("d.claims").alias("at", "c"))
    from attestor.operators.store import ordinal_ids

    flat = rows.select(
        "doc", "cell_model", (F.col("at") + 1).alias("pos"), "c.property", "c.value", "c.unit", "c.page", F.try_element_at("c.stated_conditions", F.lit("text")).alias("conditions_text"),
        F.map_filter("c.stated_conditions", lambda k, v: k != "text").alias("conditions"), "c.notes",
    )
    return ordinal_ids(flat, ["doc", "property"], ["pos"], "claim_id")


def omissions(docs: DataFrame, name: str, body: str) -> DataFrame:
    """(doc, property, note) that a document declares as left out."""
    d = docs.select(F.col(name).alias("doc"), F.explode(F.from_json(body, CLAIMS)["omissions"]).alias("o"))
    return d.select("doc", "o.property", "o.note")


def reply_claims(replies: DataFrame, reply: str) -> DataFrame:
    """``replies`` with a row for each claim of the JSON array in a model's reply.

    ``error`` says why a row is no whole claim: ``no_list`` where the reply has no readable array (``parse_error`` too), else
    ``missing: `` and the names of the fields that a claim lacks.
    """
    block = tx.json_block(F.col(reply), "[", "]")
    parsed = F.from_json(block, "array<struct<property:string,value:string,unit:string,stated_conditions:map<string,string>>>")
    rows = replies.withColumn("parsed__", F.when(block.isNotNull(), parsed))
    out = rows.select(*replies.columns, F.col("parsed__").isNull().alias("parse_error"), F.explode_outer("parsed__").alias("c"))
    unspecified = F.create_map(F.lit("text"), F.lit("unspecified"))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"c.{f}").isNull(), F.lit(f)) for f in REQUIRED]))
    error = F.when(F.col("parse_error"), "no_list").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
    return out.select(*replies.columns, "parse_error", error.alias("error"), "c.property", "c.value", "c.unit", F.coalesce("c.stated_conditions", unspecified).alias("stated_conditions"))


def pages_of(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, page, text) of documents with ``=== PAGE n ===`` marks."""
    marks = F.regexp_extract_all(body, F.lit(r"=== PAGE (\d+) ==="), F.lit(1))
    split = F.split(body, r"=== PAGE \d+ ===")
    parts = F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0)))
    rows = docs.select(F.col(key), F.explode(F.arrays_zip(marks.alias("m"), parts.alias("t"))).alias("p"))
    return rows.select(key, F.col("p.m").cast("int").alias("page"), F.col("p.t").alias("text"))
