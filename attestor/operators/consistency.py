"""Claims of several documents on one product against each other: entries, pairs, verdicts and gaps in one call.

An entry is moved once, whatever the number of pairs of documents that it takes part in: entries are ranked within their document and
value, and those of one value and rank stored as one row.  Equal values of two documents then meet within a row, and gaps
are entries beyond a rank.  Only entries that meet one of another value are moved again.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.functions.values import close, normalized
from attestor.operators import claims, matching
from attestor.storage import stored

# Conditions that are compared, and how the documents of a manufacturer are named.
CONDITIONS = (
    "temperature_c", "charge_current_a", "discharge_current_a", "charge_c_rate", "discharge_c_rate", "dod_pct", "charge_voltage_v", "retention_pct",
)
OWN_DOCUMENT = "datasheet_"
ENTRY = ("model", "source_id", "property", "pos", "value", "conditions", "text")
KEYS = ["model", "source_a", "source_b", "property"]
#: What a row of a pair holds of each side's entry.
HELD = ("pos", "claimed", "held", "bound", "text")
#: Buckets that the values of a model and property are dealt to.
DEALT = 4096


def gold_entries(gold: DataFrame) -> DataFrame:
    """Entries of claims (model, source_id, property, pos, value, unit, conditions, end_condition, text, notes).

    Values become those of the property's own unit, a percentage in the end condition becomes the condition retention_pct,
    and notes stand behind the text in brackets.
    """
    retention = tx.first_percent(F.coalesce("end_condition", F.lit("")))
    given = F.coalesce("conditions", F.create_map().cast("map<string,double>"))
    held = F.when(retention.isNotNull(), F.map_concat(F.map_filter(given, lambda k, v: k != "retention_pct"), F.create_map(F.lit("retention_pct"), retention))).otherwise(given)
    noted = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit(" ["), "notes", F.lit("]"))).otherwise("")
    return gold.select(
        "model", "source_id", "property", F.col("pos").cast("long").alias("pos"), normalized(F.col("value"), F.col("unit"), F.col("property")).alias("value"),
        F.map_filter(held, lambda k, v: v.isNotNull()).alias("conditions"), F.concat(F.coalesce("text", F.lit("")), noted).alias("text"),
    )


def document_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(model, source_a, source_b): the documents of both sides on each model, a document never with itself."""
    own = a.select("model", F.col("source_id").alias("source_a")).distinct()
    return own.join(b.select("model", F.col("source_id").alias("source_b")).distinct(), "model").where("source_a <> source_b")


def compared(a: DataFrame, b: DataFrame, pairs: DataFrame, omissions: DataFrame) -> DataFrame:
    """Every entry of both documents of each pair once: matched with the closest of its property, or a gap.

    ``pairs`` has (model, source_a, source_b), ``omissions`` (model, source_id, property) of gaps known from a complete reading.
    Returns (model, source_a, source_b, property, i, j, value_a, value_b, delta, verdict, detail, provenance, text_a, text_b).
    """
    cells = _cells(_on_sides(a, True, False).unionByName(_on_sides(b, False, True)))
    return _compared(cells, _documents(cells), pairs, omissions)


def _on_sides(rows: DataFrame, as_a: bool, as_b: bool) -> DataFrame:
    return rows.select(*ENTRY, F.lit(as_a).alias("as_a"), F.lit(as_b).alias("as_b"))


def _cells(entries: DataFrame) -> DataFrame:
    """(model, property, value, rank, members): the entries of all documents that have one rank among those of their document and value.

    ``value`` is the one that entries are matched by.  A member has its sides as_a and as_b; where an entry's rank isn't the same on both,
    it is a member of two cells.  The entries are dealt by model, property and value once, which serves ranks and cells.
    """
    point = F.coalesce(F.get("value", F.lit(0)), F.lit(0.0))
    held = F.struct(*[F.try_element_at("conditions", F.lit(c)).alias(c) for c in sorted(CONDITIONS)])
    rows = entries.select("model", "property", F.pmod(F.hash(point), F.lit(DEALT)).alias("bucket"), "source_id", point.alias("point"), F.col("pos").cast("long").alias("pos"), F.col("value").alias("claimed"), held.alias("held"), "text", "as_a", "as_b")
    of = Window.partitionBy("model", "property", "bucket", "point", "source_id").orderBy("pos", "text", "held", "claimed").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.repartition("model", "property", "bucket").withColumns({f"rank_{s}": F.sum(F.col(f"as_{s}").cast("long")).over(of) for s in "ab"})
    at = lambda rank, a, b: F.struct(rank.alias("rank"), a.alias("on_a"), b.alias("on_b"))
    no, (rank_a, rank_b), (as_a, as_b) = F.lit(False), (F.col("rank_a"), F.col("rank_b")), (F.col("as_a"), F.col("as_b"))
    both = F.array(at(rank_a, as_a, as_b))
    each = F.when(as_a & as_b & (rank_a == rank_b), both).otherwise(F.filter(F.array(at(rank_a, as_a, no), at(rank_b, no, as_b)), lambda x: x["on_a"] | x["on_b"]))
    placed = ranked.select("model", "property", "bucket", "point", "source_id", "pos", "claimed", "held", "text", F.inline(each))
    member = F.struct("source_id", F.col("on_a").alias("as_a"), F.col("on_b").alias("as_b"), "pos", "claimed", "held", tx.bound(F.col("text")).alias("bound"), "text")
    cells = placed.groupBy("model", "property", "bucket", F.col("point").alias("value"), "rank").agg(F.collect_list(member).alias("members"))
    return stored(cells.drop("bucket"), "cells")


def _members(cells: DataFrame, *fields: str) -> DataFrame:
    """(model, property, value, rank, source_id, as_a, as_b, fields) of every member."""
    names = ["source_id", "as_a", "as_b", *fields]
    each = F.explode(F.arrays_zip(*[F.col(f"members.{c}").alias(c) for c in names]))
    return cells.select("model", "property", "value", "rank", each.alias("m")).select("model", "property", "value", "rank", *[F.col(f"m.{c}").alias(c) for c in names])


def _documents(cells: DataFrame) -> DataFrame:
    """(model, source_id, property, value, n0, n1): how many entries each document has on the sides."""
    n = [F.count_if(f"as_{s}").alias(f"n{k}") for k, s in enumerate("ab")]
    return stored(_members(cells).groupBy("model", "source_id", "property", "value").agg(*n), "documents")


def _compared(cells: DataFrame, documents: DataFrame, pairs: DataFrame, omissions: DataFrame) -> DataFrame:
    pairs = stored(pairs.select("model", "source_a", "source_b").distinct(), "pairs-of-documents")
    size = lambda k, s: documents.where(f"n{k} > 0").withColumnRenamed("source_id", f"source_{s}").join(pairs, ["model", f"source_{s}"]).select(*KEYS, "value", *[F.col(c) if c == f"n{k}" else F.lit(0).alias(c) for c in ("n0", "n1")])
    sizes = size(0, "a").unionByName(size(1, "b")).groupBy(*KEYS, "value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = stored(sizes.withColumn("equal", F.least("n0", "n1")), "counts")
    given, found = matching.given_in_rounds(counts, KEYS, lambda taking: _entries_of(_members(cells, "pos"), taking))
    parts = [_equal(cells, pairs), _gaps(cells, counts, given, omissions)]
    return _judged(functools.reduce(DataFrame.unionByName, parts + ([_met(cells, given, found)] if given else [])))


def _entries_of(members: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` (keys, value, side, ...), a short table, with the members of each on its side."""
    left = F.col("side") == 0
    of = values.withColumn("source_id", F.when(left, F.col("source_a")).otherwise(F.col("source_b")))
    return matching.joined(members, of, ["model", "source_id", "property", "value"]).where(F.when(left, F.col("as_a")).otherwise(F.col("as_b"))).drop("source_id", "as_a", "as_b")


def _side(entry: str | None, s: str, keep: Column | None = None) -> list[Column]:
    """The columns of one side of a row: those of a struct, or of the row itself where ``keep`` holds."""
    of = lambda c: F.col(f"{entry}.{c}") if entry else F.when(keep, F.col(c))
    return [of(c).alias(f"{c}_{s}") for c in HELD]


def _equal(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entries of equal value and rank of each two documents."""
    a = cells.select("model", "property", "members", F.explode("members").alias("a")).where("a.as_a")
    b = a.select("model", "property", "a", F.explode("members").alias("b")).where("b.as_b")
    named = b.select("model", F.col("a.source_id").alias("source_a"), F.col("b.source_id").alias("source_b"), "property", *_side("a", "a"), *_side("b", "b"))
    return named.join(pairs, ["model", "source_a", "source_b"]).withColumns({"absent": F.lit(None).cast("string"), "verified": F.lit(False)})


def _gaps(cells: DataFrame, counts: DataFrame, given: list[DataFrame], omissions: DataFrame) -> DataFrame:
    """Entries behind the ranks of their value that a pair's other document has taken."""
    left = counts.withColumns({"side": (F.col("n1") > F.col("n0")).cast("int"), "done": F.col("equal")})
    if given:
        taken = functools.reduce(DataFrame.unionByName, given).groupBy(*KEYS, "value").agg(F.sum("n").alias("taken"))
        left = matching.joined(left, taken, [*KEYS, "value"], "left").withColumn("done", F.col("equal") + F.coalesce("taken", F.lit(0)))
    known = omissions.select("model", F.col("source_id").alias("absent"), "property").distinct().withColumn("verified", F.lit(True))
    left = left.where(F.col("done") < F.greatest("n0", "n1")).withColumn("absent", F.when(F.col("side") == 0, F.col("source_b")).otherwise(F.col("source_a")))
    left = stored(left.join(known, ["model", "absent", "property"], "left").select(*KEYS, "value", "side", "done", "absent", F.coalesce("verified", F.lit(False)).alias("verified")), "left")
    rows = _entries_of(_members(cells, *HELD), left).where("rank > done")
    return rows.select(*KEYS, *_side(None, "a", F.col("side") == 0), *_side(None, "b", F.col("side") == 1), "absent", "verified")


def _met(cells: DataFrame, given: list[DataFrame], found: list[DataFrame]) -> DataFrame:
    """Entries that met one of another value, by ranges of ranks or by position."""
    ranges = stored(functools.reduce(DataFrame.unionByName, given), "ranges")
    rows = _entries_of(_members(cells, *HELD), ranges).where("rank > start and rank <= start + n")
    taken = rows.where("slot is not null").withColumn("nth", F.col("base") + F.col("rank") - F.col("start"))
    place = [*KEYS, "slot", "nth"]
    placed = taken.select(*place, "side", *HELD)
    if found:
        ends = [F.struct(F.lit(side).alias("side"), F.col(v).alias("value"), F.col(r).alias("rank")) for side, v, r in ((0, "x", "ri"), (1, "y", "rj"))]
        pairs = functools.reduce(DataFrame.unionByName, found).select(*KEYS, F.col("x").alias("slot"), F.col("ri").alias("nth"), F.inline(F.array(*ends)))
        by_position = rows.where("slot is null").select(*KEYS, "side", "value", "rank", *HELD)
        placed = placed.unionByName(matching.joined(by_position, pairs, [*KEYS, "side", "value", "rank"]).select(*place, "side", *HELD))
    entry = lambda side: F.first(F.when(F.col("side") == side, F.struct(*HELD)), ignorenulls=True)
    both = placed.groupBy(*place).agg(entry(0).alias("a"), entry(1).alias("b"))
    return both.select(*KEYS, *_side("a", "a"), *_side("b", "b"), F.lit(None).cast("string").alias("absent"), F.lit(False).alias("verified"))


def _judged(both: DataFrame) -> DataFrame:
    """Rows with both sides' entries and ``absent``, the document that a gap is in, by verdict."""
    both = both.withColumnsRenamed({"pos_a": "i", "pos_b": "j", "claimed_a": "value_a", "claimed_b": "value_b"})
    a, b = F.col("held_a"), F.col("held_b")
    differ = {c: F.coalesce(~close(a[c], b[c]), F.lit(False)) for c in sorted(CONDITIONS)}
    judged = claims.judged(F.col("value_a"), functools.reduce(Column.__or__, differ.values()), F.col("bound_a"), F.col("value_b"), F.col("bound_b"))
    verdict = F.when(F.col("absent").isNotNull(), "coverage_gap").otherwise(judged)
    x, y = F.get("value_a", F.lit(0)), F.get("value_b", F.lit(0))
    points = (F.size("value_a") == 1) & (F.size("value_b") == 1) & (x != 0)
    own = F.col("source_a").startswith(OWN_DOCUMENT) & F.col("source_b").startswith(OWN_DOCUMENT)
    mismatches = F.concat_ws("; ", *[F.when(d, F.concat(F.lit(f"{c}: "), a[c].cast("string"), F.lit(" vs "), b[c].cast("string"))) for c, d in differ.items()])
    return both.withColumn("verdict", verdict).select(
        *KEYS, "i", "j", "value_a", "value_b", F.when(points, (y - x) / F.abs(x)).alias("delta"), "verdict", _detail(mismatches).alias("detail"),
        F.when(own, "manufacturer_internal").otherwise("ecosystem").alias("provenance"), "text_a", "text_b",
    )


def _detail(mismatches: Column) -> Column:
    """Why a row has its verdict."""
    gap = F.concat(F.lit("absent in "), "absent", F.when(F.col("verified"), " - verified omission").otherwise(" - may reflect the scope of extraction"))
    shown = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "..")
    return (
        F.when(F.col("verdict") == "coverage_gap", gap).when(F.col("verdict") == "condition_mismatch", mismatches)
        .when(F.col("verdict") == "consistent", "values match or satisfy a stated bound").otherwise(F.concat(shown(F.col("value_a")), F.lit(" vs "), shown(F.col("value_b"))))
    )


def consistency(gold: DataFrame, echoes: DataFrame, omissions: DataFrame) -> DataFrame:
    """Gold claims against repeated specifications, and the gold documents of a model against each other.

    ``gold`` are entries, ``echoes`` entries too.  Two gold documents meet once, the one with the smaller id as side a.
    """
    cells = _cells(_on_sides(gold, True, True).unionByName(_on_sides(echoes, False, True)))
    documents = _documents(cells)
    own, others = documents.where("n0 > 0"), documents.where("n1 > n0")  # side b has the entries of both
    pairs = document_pairs(own, others).unionByName(document_pairs(own, own).where("source_a < source_b"))
    return _compared(cells, documents, pairs, omissions)


def summary(rows: DataFrame) -> DataFrame:
    """(model, n, consistent, condition_mismatch, document_variant_conflict, coverage_gap) of compared rows."""
    kinds = ("consistent", "condition_mismatch", "document_variant_conflict", "coverage_gap")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])


def verified_on_page(rows: DataFrame, pages: DataFrame, forms: str = "forms") -> DataFrame:
    """``rows`` (doc, page, forms) with ``status`` and ``other_pages``: whether a printed form stands on the cited page.

    White space and commas are of no account.  ``pages`` has (doc, page, text); a document without text can't be read, a claim
    without forms can't be verified.
    """
    squash = lambda c: F.regexp_replace(c, r"[\s,]", "")
    numbered = stored(rows.withColumn("row__", F.monotonically_increasing_id()), "numbered")
    body = pages.select(F.col("doc").alias("doc__"), F.col("page").alias("page__"), squash(F.coalesce("text", F.lit(""))).alias("body__"))
    hit = F.exists(forms, lambda x: F.contains(F.col("body__"), squash(x)))
    each = numbered.join(body, F.col("doc") == F.col("doc__"), "left").withColumn("hit__", F.coalesce(hit, F.lit(False)))
    seen = each.groupBy("row__").agg(
        F.bool_or(F.col("hit__") & F.col("page__").eqNullSafe(F.col("page"))).alias("cited"), F.array_sort(F.collect_set(F.when(F.col("hit__"), F.col("page__")))).alias("hits"),
        F.bool_or(F.coalesce(F.col("body__"), F.lit("")) != "").alias("readable"),
    )
    status = (
        F.when(~F.col("readable"), "no text layer").when(F.size(forms) == 0, "unverifiable").when(F.col("cited"), "found on cited page")
        .when(F.size("hits") > 0, "found on other page(s)").otherwise("NOT FOUND in text")
    )
    out = numbered.join(seen, "row__").withColumn("status", status)
    return out.withColumn("other_pages", F.when(F.col("status") == "found on other page(s)", F.array_join(F.transform("hits", lambda p: p.cast("string")), ",")).otherwise("")).select(*rows.columns, "status", "other_pages")
