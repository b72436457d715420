"""What kind of claim a row is: its stratum, its category, and the fields that a file name encodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of grid properties, the word that marks a plotted value, the ordered categories (which text of a claim
# a pattern is held against), and the pattern of file names.
GRID = r"^rel_|relative_|^capacity_retention_at_temp_pct$"
PLOTTED = "(?i)graph"
STRATA = ("characteristic grid", "read from graph", "specification row")
CATEGORIES = [
    ("cell dimensions", "unit or property", r"(?i)^mm$", r"_mm$"),
    ("charge-termination (cut-off) currents", "property", r"(?i)end_current|termination|taper|precharge", None),
    ("limit specs (max current / cut-off voltage)", "property", r"(?i)^max_|_cutoff_v$|^cut_?off", None),
    ("storage-duration rows", "property and text", r"^storage", r"(?i)\b(month|months|year|years|week|weeks|day|days)\b"),
    ("plot-derived values", "notes", r"(?i)read from (the )?graph|read off|from the (curve|plot|graph)|graph-derived|off the (curve|plot)", None),
    ("test-criterion rows", "notes", r"(?i)pass criterion|shall be|acceptance|\btest\b", None),
]
OTHER = "other"
FILE_NAME = r"SNL_18650_LFP_(\d+)C_([\d\-]+)_([\d.]+)-([\d.]+)C_(\w+)_cycle_data\.csv$"


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def stratum(prop: Column, notes: Column, conditions: Column) -> Column:
    """Where a claim stands in its document."""
    plotted = _text(notes).rlike(PLOTTED) | _text(conditions).rlike(PLOTTED)
    return F.when(prop.rlike(GRID), STRATA[0]).when(plotted, STRATA[1]).otherwise(STRATA[2])


def category(prop: Column, unit: Column, notes: Column, conditions: Column) -> Column:
    """The first category that a claim meets."""
    prop, unit, said = _text(prop), _text(unit), F.concat(_text(notes), F.lit(" "), _text(conditions))
    out = F.lit(OTHER)
    for name, where, one, two in reversed(CATEGORIES):
        meets = {
            "unit or property": lambda one=one, two=two: unit.rlike(one) | prop.rlike(two or one), "property": lambda one=one: prop.rlike(one),
            "property and text": lambda one=one, two=two: prop.rlike(one) & _text(conditions).rlike(two or one), "notes": lambda one=one: said.rlike(one),
        }[where]()
        out = F.when(meets, name).otherwise(out)
    return out


def _plain(number: Column) -> Column:
    return F.regexp_replace(number.cast("double").cast("string"), r"\.0$", "")


def file_fields(name: Column) -> Column:
    """struct of the five fields that the last part of a path encodes, null for any other name."""
    last = F.element_at(F.split(name, "/"), -1)
    g = lambda k: F.regexp_extract(last, FILE_NAME, k)
    fields = F.struct(
        g(1).cast("double").alias("temperature_c"), F.concat(g(2), F.lit("%")).alias("dod_window"), F.concat(_plain(g(3)), F.lit("C")).alias("c_rate_charge"),
        F.concat(_plain(g(4)), F.lit("C")).alias("c_rate_discharge"), g(5).alias("replicate"),
    )
    return F.when(last.rlike(FILE_NAME), fields)
