"""Review pages: the specifications they repeat, the measurements they state, and those that they only show as charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as tx

# Where a page repeats specifications, sentences that state a measurement (the groups of its value and of
# one condition, notes), images that hold one, words for minutes.
ECHO = r"(?is)Official specifications:\s*<ul>(.*?)</ul>"
STATEMENTS = [
    (r"(?i)At (\d+(?:\.\d+)?)A the cell reaches (\d+)\s?°?C", "measured_cell_temp_c", "degC", 2, "discharge_current_a", 1, None),
    (r"(?is)At (\d+(?:\.\d+)?)A I terminated due to temperature.*?reach (\d+)\s?°?C", "measured_cell_temp_c", "degC", 2, "discharge_current_a", 1, "discharge terminated early due to temperature"),
    (r"(?i)deliver (\d+(?:\.\d+)?)A, but only for (\w+) minutes?", "measured_sustained_current_a", "A", 1, "duration_min", 2, None),
    (r"(?i)I only discharges? to (\d+(?:\.\d+)?) volt", "test_discharge_cutoff_v", "V", 1, None, None, "review's test cutoff; full capacity not measured"),
]
CHARTS = [("measured_capacity_ah", r"-Capacity\.png"), ("measured_energy_wh", r"-Energy\.png")]
MINUTES = {"one": 1.0, "two": 2.0, "three": 3.0}
FRAGMENT = 240
MEASUREMENT = "struct<property:string,value:double,unit:string,conditions:map<string,double>,note:string,chart_only:boolean,fragment:string>"


def echo_lines(html: Column) -> Column:
    """The items of the list of official specifications; its items need not be closed."""
    items = F.split(F.regexp_extract(html, ECHO, 1), "<li>")
    bare = F.transform(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), lambda x: tx.flat(F.regexp_replace(x, r"<[^>]+>", " ")))
    return F.filter(bare, lambda x: x != "")


def _stated(sentence: Column) -> Column:
    """The measurements that one sentence states, one for each pattern that it meets."""
    found = []
    for pattern, prop, unit, value, name, given, note in STATEMENTS:
        number = lambda g, pattern=pattern: F.regexp_extract(sentence, pattern, g)
        conditions = F.create_map().cast("map<string,double>")
        if name == "duration_min":
            words = F.create_map(*[F.lit(x) for pair in MINUTES.items() for x in pair])
            minutes = F.try_element_at(words, F.lower(number(given)))
            conditions = F.when(minutes.isNotNull(), F.create_map(F.lit(name), minutes)).otherwise(conditions)
        elif name:
            conditions = F.create_map(F.lit(name), number(given).cast("double"))
        one = F.struct(
            F.lit(prop).alias("property"), number(value).cast("double").alias("value"), F.lit(unit).alias("unit"), conditions.alias("conditions"), F.lit(note).cast("string").alias("note"),
            F.lit(False).alias("chart_only"), F.substring(sentence, 1, FRAGMENT).alias("fragment"),
        ).cast(MEASUREMENT)
        found.append(F.when(sentence.rlike(pattern), one))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _charts(html: Column) -> Column:
    """Measurements that a page has as images only, without values."""
    found = []
    for prop, image in CHARTS:
        first = F.regexp_extract(html, rf'<img src="[^"]*/([^"/]*{image})"', 1)
        one = F.struct(
            F.lit(prop).alias("property"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.create_map().cast("map<string,double>").alias("conditions"),
            F.lit(None).cast("string").alias("note"), F.lit(True).alias("chart_only"),
            F.concat(F.lit("data presented only as chart image: "), F.replace(first, F.lit("%20"), F.lit(" "))).alias("fragment"),
        ).cast(MEASUREMENT)
        found.append(F.when(first != "", one))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def measurements(html: Column) -> Column:
    """All measurements of a page: stated ones by sentence, then those shown as charts."""
    return F.concat(F.flatten(F.transform(tx.sentences(tx.html_text(html)), _stated)), _charts(html))


def assembled(pages: DataFrame, html: str, *kept: str) -> DataFrame:
    """(kept, spec_echo, measurements, n_stated, n_charts): one nested review for each page; a null page has empty lists."""
    text = F.coalesce(F.col(html), F.lit(""))
    out = pages.select(*kept, echo_lines(text).alias("spec_echo"), measurements(text).alias("measurements"))
    charts = F.size(F.filter("measurements", lambda m: m["chart_only"]))
    return out.withColumns({"n_stated": F.size("measurements") - charts, "n_charts": charts})
