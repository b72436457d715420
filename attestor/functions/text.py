"""Column expressions over text: numbers, sentences, names, answers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.values import SMALL_UNITS, close

# Patterns of mark-up, sentence ends, numbers, percentages, policies, tolerances, bounds, sources, hedges and fences.
IMAGE, TAG, BLANKS = r"<img[^>]*>", r"<[^>]+>", r"[ \t]+"
SENTENCE_END = r"(?<=[.!?])\s+|\n"
ITEM, LIST_END = r"(?i)<li[^>]*>", r"(?is)</(?:li|ul|ol)>.*$"
SEPARATOR = r"(?<=\d),(?=\d{3}\b)"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
FENCE = r"(?m)^```(?:json)?\s*|\s*```$"
NUMBER = r"-?\d+(?:\.\d+)?"
ANSWER_NUMBER = r"(?i)(-?\d[\d,]*(?:\.\d+)?)\s*(mAh|Ah|mA|A|mV|V|mΩ|mOhm|g|%|°C|degC|Wh/kg|Wh/l|h|hours|min|cycles)?"
POLICY = r"^(\d+(?:\.\d+)?)C\((\d+(?:\.\d+)?)%\)-(\d+(?:\.\d+)?)C$"
PLUS_MINUS = r"(-?\d+(?:\.\d+)?)\s*(?:±|\+/-|\+-)\s*(\d+(?:\.\d+)?)"
UPPER = r"(?i)\b(max|maximum|less than|up to|no more than)\b|<|≤"
LOWER = r"(?i)(?<!\d)(?<!\d\s)\bmin(?!ute)\b\.?|\b(minimum|over|at least|more than)\b|>|≥"
HEDGE = (
    r"(?i)(not (entirely |completely )?certain|I don'?t know|cannot confirm|unsure|uncertain|may vary|approximately|not specified|I do not have"
    r"|varies by|couldn'?t find|no reliable|not able to verify)"
)
SOURCE = r"(?i)(p\.\s*\d+|page \d+|https?://|doi\.org|full (product )?specification|marketing (sheet|datasheet)|product specification)"
TRIAGE = r"(?is)^\s*(yes|maybe|no)\s*[:\-–]\s*(.+)$"
QUANTITY = r"(?iu)^[-−~]?\s*\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:%|℃|°C|mAh|Ah|mA|A|mV|V|mΩ|mOhm|cycles?|g|mm|min|h)?$"


def html_text(html: Column) -> Column:
    """Images become a space, other tags a line break, blanks and tabs one space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, IMAGE, " "), TAG, "\n"), BLANKS, " ")


def sentences(text: Column) -> Column:
    """Trimmed non-empty parts between sentence ends or line breaks."""
    parts = F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def list_items(html: Column) -> Column:
    """The texts of the items of all lists, also of unclosed ones."""
    parts = F.split(html, ITEM)
    items = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, LIST_END, ""), TAG, " "), r"\s+", " ")))
    return F.filter(bare, lambda x: x != "")


def numbers(text: Column) -> Column:
    """All numbers; a typographic minus counts as one and thousands separators don't split."""
    plain = F.regexp_replace(F.regexp_replace(text, "−", "-"), SEPARATOR, "")
    return raw_numbers(plain)


def raw_numbers(text: Column) -> Column:
    """All numbers as written, without repairs of separators."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def plus_minus(text: Column) -> Column:
    """array<struct<x, y>> of all ``X ± Y``."""
    x = F.regexp_extract_all(text, F.lit(PLUS_MINUS), F.lit(1))
    y = F.regexp_extract_all(text, F.lit(PLUS_MINUS), F.lit(2))
    return F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))


def first_percent(text: Column) -> Column:
    """The first number before a percent sign."""
    return F.nullif(F.regexp_extract(text, PERCENT, 1), F.lit("")).cast("double")


def bound(text: Column) -> Column:
    """upper, lower or null: which way a text bounds its value."""
    return F.when(text.rlike(UPPER), "upper").when(text.rlike(LOWER), "lower")


def policy_name(policy: Column) -> Column:
    """The policy without its structure tag; empty ones are null."""
    return F.nullif(F.trim(F.replace(policy, F.lit("-newstructure"), F.lit(""))), F.lit(""))


def policy_parts(policy: Column) -> Column:
    """struct<c1, soc, c2> of a two-step policy, null for any other text."""
    part = lambda k: F.regexp_extract(policy, POLICY, k).cast("double")
    return F.when(policy.rlike(POLICY), F.struct(part(1).alias("c1"), part(2).alias("soc"), part(3).alias("c2")))


def answer_numbers(answer: Column) -> Column:
    """array<struct<n, unit>> of the numbers in an answer with the unit behind each."""
    text = F.replace(answer, F.lit("−"), F.lit("-"))
    n = F.regexp_extract_all(text, F.lit(ANSWER_NUMBER), F.lit(1))
    unit = F.regexp_extract_all(text, F.lit(ANSWER_NUMBER), F.lit(2))
    return F.transform(F.arrays_zip(n.alias("n"), unit.alias("u")), lambda p: F.struct(F.replace(p["n"], F.lit(","), F.lit("")).cast("double").alias("n"), F.lower(p["u"]).alias("unit")))


def score_value(answer: Column, gold: Column, gold_unit: Column) -> Column:
    """correct, unit_confused, wrong or no_value for the gold values (an array) in an answer."""
    said = answer_numbers(answer)
    small = F.array(*map(F.lit, SMALL_UNITS))
    gold_small = F.array_contains(small, F.lower(F.coalesce(gold_unit, F.lit(""))))

    def found(g: Column) -> Column:
        g = F.abs(g)
        shifted = F.element_at(F.filter(said, lambda s: close(F.abs(s["n"]), g * 1000) | close(F.abs(s["n"]) * 1000, g)), 1)
        by_unit = F.when(close(F.abs(shifted["n"]), g * 1000), F.array_contains(small, shifted["unit"])).otherwise(gold_small)
        return (
            F.when(F.exists(said, lambda s: close(F.abs(s["n"]), g)), "correct")
            .when(F.exists(said, lambda s: close(F.abs(s["n"]), g * 1000) | close(F.abs(s["n"]) * 1000, g)), F.when(by_unit, "correct").otherwise("unit_confused"))
            .otherwise("none")
        )

    each = F.transform(gold, found)
    return (
        F.when(F.size(said) == 0, "no_value")
        .when(F.forall(each, lambda r: r == "correct"), "correct")
        .when(F.exists(each, lambda r: r == "unit_confused"), "unit_confused")
        .otherwise("wrong")
    )


def hedges(answer: Column) -> Column:
    """Whether an answer says that it is unsure."""
    return answer.rlike(HEDGE)


def names_source(answer: Column) -> Column:
    """Whether an answer names a source that can be looked up."""
    return answer.rlike(SOURCE)


def squashed_key(text: Column) -> Column:
    """``title:`` and 16 hex digits of the SHA-1 of the lower-case text without anything but letters and digits."""
    return F.concat(F.lit("title:"), F.substring(F.sha1(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")), 1, 16))


def source_key(doi: Column, arxiv: Column, title: Column) -> Column:
    """The best identifier there is: DOI, then preprint number, then title."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(some(doi))), F.concat(F.lit("arxiv:"), F.lower(some(arxiv))), squashed_key(title))


def triage(reply: Column) -> Column:
    """struct<decision, rationale>: yes, maybe or no with at most 300 characters of reason; else unparsed and 200 of the reply."""
    bare = F.regexp_replace(reply, r"^\s+|\s+$", "")
    known = bare.rlike(TRIAGE)
    return F.struct(
        F.when(known, F.lower(F.regexp_extract(bare, TRIAGE, 1))).otherwise("unparsed").alias("decision"),
        F.when(known, F.substring(flat(F.regexp_extract(bare, TRIAGE, 2)), 1, 300)).otherwise(F.substring(bare, 1, 200)).alias("rationale"),
    )


def query_key(query: Column, params: Column) -> Column:
    """The query with single spaces and its parameters (a map) in order of their names, as one string."""
    entries = F.array_sort(F.map_entries(params))
    ordered = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}"))
    return F.concat_ws("|", F.trim(F.regexp_replace(query, r"\s+", " ")), ordered)


def json_block(reply: Column, opening: str, closing: str) -> Column:
    """What lies from the first opening to the last closing sign, code fences removed; null if there is none."""
    bare = F.trim(F.regexp_replace(reply, FENCE, ""))
    first, last = F.instr(bare, opening), F.length(bare) - F.instr(F.reverse(bare), closing) + 1
    return F.when((first > 0) & (F.instr(bare, closing) > 0) & (last > first), F.substr(bare, first, last - first + 1))


def flat(cell: Column) -> Column:
    """The text on one line with single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def is_quantity(cell: Column) -> Column:
    """Whether a table cell is a bare number with perhaps a unit."""
    return flat(cell).rlike(QUANTITY)
