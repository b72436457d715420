"""Expressions over stated conditions: maps of texts, whose numbers are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.functions.values import close, in_numbers


def numbers_of(conditions: Column) -> Column:
    """All numbers in a map's values, without its ``text`` and names that start with an underscore."""
    used = F.map_filter(conditions, lambda k, v: (k != "text") & ~k.startswith("_"))
    return F.coalesce(F.flatten(F.transform(F.map_values(used), lambda v: tx.raw_numbers(F.coalesce(v, F.lit(""))))), F.array().cast("array<double>"))


def correct(gold: Column, quote: Column, predicted: Column) -> Column:
    """Whether a prediction states the gold conditions' numbers or, where there are none, invents none beside the quote's."""
    g, p, q = numbers_of(gold), numbers_of(predicted), tx.raw_numbers(F.coalesce(quote, F.lit("")))
    stated = F.forall(g, lambda x: F.exists(p, lambda y: close(x, y)))
    grounded = F.forall(p, lambda y: F.exists(q, lambda z: close(y, z)))
    return F.when(F.size(g) > 0, stated).otherwise(grounded)


def over_extracted(gold: Column, quote: Column, predicted: Column) -> Column:
    """Whether a prediction has a number with no basis in the gold conditions or their quote, in any scale."""
    allowed = F.concat(numbers_of(gold), tx.raw_numbers(F.coalesce(quote, F.lit(""))))
    return F.exists(numbers_of(predicted), lambda p: ~in_numbers(p, allowed))


def grounded(conditions: Column, page: Column) -> Column:
    """The conditions whose numbers all occur on the page; if only the text is left it becomes ``unspecified``."""
    found = tx.numbers(page)
    kept = F.map_filter(conditions, lambda k, v: ~k.startswith("_") & ((k == "text") | F.forall(tx.raw_numbers(v), lambda x: in_numbers(x, found))))
    bare = F.size(F.map_filter(kept, lambda k, v: k != "text")) == 0
    return F.when(bare, F.create_map(F.lit("text"), F.lit("unspecified"))).otherwise(kept)


def stated_in(answer: Column, gold: Column) -> Column:
    """Whether an answer has all of the gold conditions' numbers, null where there are none."""
    said = F.transform(tx.answer_numbers(answer), lambda s: F.abs(s["n"]))
    g = numbers_of(gold)
    near = lambda x, a: close(x, a) | close(x * 1000, a) | ((x >= 1000) & close(x / 1000, a))
    return F.when(F.size(g) > 0, F.forall(g, lambda x: F.exists(said, lambda a: near(F.abs(x), a))))


def outcome(a: Column, b: Column) -> Column:
    """How two sides' conditions (maps without text) relate: identical, conflicting, richer on a side, one-sided or none."""
    ka, kb = F.map_keys(a), F.map_keys(b)
    shared = F.array_intersect(ka, kb)
    bad = F.exists(shared, lambda k: F.trim(F.element_at(a, k)) != F.trim(F.element_at(b, k)))
    only_a, only_b = F.size(F.array_except(ka, kb)) > 0, F.size(F.array_except(kb, ka)) > 0
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "both_unspecified").when(F.size(a) == 0, "b_only").when(F.size(b) == 0, "a_only")
        .when(bad, "conflicting").when(~only_a & ~only_b, "identical").when(only_a & ~only_b, "a_richer").when(only_b & ~only_a, "b_richer").otherwise("partial")
    )


def similarity(a: Column, a_text: Column, a_page: Column, b: Column, b_text: Column, b_page: Column) -> Column:
    """Two for each equal condition, the Jaccard of the texts' words, and a half for the same page."""
    same = F.size(F.filter(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: F.trim(F.element_at(a, k)) == F.trim(F.element_at(b, k))))
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: w != ""))
    x, y = words(a_text), words(b_text)
    jaccard = F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))
    return 2.0 * same + jaccard + F.when(a_page.eqNullSafe(b_page), 0.5).otherwise(0.0)
