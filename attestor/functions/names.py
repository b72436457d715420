"""Expressions that make and read names: axis tokens, composed properties, sections, printed values, table rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import flat, is_quantity

# Families and axes of a grid's properties, the modes of one axis, how a section begins, units that may be
# printed a thousandfold, and what makes a table region a grid or a specification table.
FAMILIES = ("rel_discharge_capacity", "rel_charge_capacity", "rel_capacity")
AXES = ("temperature_c", "current_a", "charge_mode")
CHARGE_MODES = ("std", "rapid")
SECTION = r"""^\s*'?"?(\d+(?:\.\d+)*)\s*([A-Za-z][^|:,;]{0,44})?"""
MILLI_UNITS = ("a", "ah", "v")
GRID_ROWS, GRID_CELLS, SPEC_COLUMNS, SPEC_ROWS = 2, 2, 2, 4


def _plain(number: Column) -> Column:
    """A number without trailing zeros, up to ten decimals."""
    return F.regexp_replace(F.format_string("%.10f", number), r"\.?0+$", "")


def axis_token(kind: Column, value: Column) -> Column:
    """The token of an axis value (text); an unknown axis or mode is an error."""
    number = value.try_cast("double")
    tidy = F.replace(_plain(F.abs(number)), F.lit("."), F.lit("_"))
    mode = F.lower(F.trim(value))
    known_mode = F.when(mode.isin(*CHARGE_MODES), mode).otherwise(F.raise_error(F.concat(F.lit("unknown charge mode "), value)).cast("string"))
    return (
        F.when(kind == "temperature_c", F.concat(F.when(number < 0, "m").otherwise(""), tidy, F.lit("c")))
        .when(kind == "current_a", F.concat(F.when(number < 0, "-").otherwise(""), tidy, F.lit("a")))
        .when(kind == "charge_mode", known_mode)
        .otherwise(F.raise_error(F.concat(F.lit("unknown axis "), kind)).cast("string"))
    )


def property_name(family: Column, kind: Column, value: Column) -> Column:
    """<family>_<token>_pct, or <family>_<mode>_charge_pct; an unknown family is an error."""
    known = F.when(family.isin(*FAMILIES), family).otherwise(F.raise_error(F.concat(F.lit("unknown family "), family)).cast("string"))
    return F.concat(known, F.lit("_"), axis_token(kind, value), F.when(kind == "charge_mode", "_charge_pct").otherwise("_pct"))


def section(text: Column) -> Column:
    """§number and title of a leading section number, §number without a title, — for anything else and null."""
    title = F.regexp_replace(F.regexp_extract(text, SECTION, 2), r"""^[ '"—-]+|[ '"—-]+$""", "")
    label = F.concat(F.lit("§"), F.regexp_extract(text, SECTION, 1), F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""))
    return F.when(text.rlike(SECTION), label).otherwise("—")


def parsed_value(text: Column) -> Column:
    """array<double> of a printed number or list, null for anything else."""
    return F.coalesce(F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<double>")), F.when(text.try_cast("double").isNotNull(), F.array(text.try_cast("double"))))


def _general(number: Column) -> Column:
    """Six significant digits without trailing zeros, with an exponent for very large and small numbers."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", number), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def printed_forms(value: Column, unit: Column) -> Column:
    """How a number may be printed: as it is, in thousandths of a unit that allows it, and whole ones with a decimal."""
    milli = F.when(F.lower(unit).isin(*MILLI_UNITS), _general(value * 1000))
    whole = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string"))
    return F.array_distinct(F.array_compact(F.array(_general(value), milli, whole, F.concat(whole, F.lit(".0")))))


def quantity_rows(rows: Column) -> Column:
    """Numbers of the rows of a table (array of arrays) that have two or more quantities."""
    marked = F.transform(rows, lambda r, i: F.when(F.size(F.filter(r, is_quantity)) >= GRID_CELLS, i))
    return F.filter(marked, lambda x: x.isNotNull())


def _width(rows: Column) -> Column:
    return F.array_max(F.transform(rows, F.size))


def region_kind(rows: Column) -> Column:
    """grid for two or more quantity rows, spec_table for two columns and four or more rows, else other."""
    return F.when(F.size(quantity_rows(rows)) >= GRID_ROWS, "grid").when((_width(rows) == SPEC_COLUMNS) & (F.size(rows) >= SPEC_ROWS), "spec_table").otherwise("other")


def rendered(rows: Column) -> Column:
    """Rows as lines of cells between bars, cells on one line each, short rows padded."""
    width = _width(rows)
    cells = lambda r: F.concat(F.transform(r, flat), F.array_repeat(F.lit(""), width - F.size(r)))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(cells(r), " | "), F.lit(" |"))), "\n")
