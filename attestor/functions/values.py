"""Column expressions over claimed and measured values: tolerances, units, comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative tolerance of equal values, factors of small units, classes of units.
TOLERANCE = 0.02
SMALL_UNITS = {"mah": 1e-3, "ma": 1e-3, "mv": 1e-3}
UNIT_CLASSES = {
    "mah": "capacity", "ah": "capacity", "ma": "current", "a": "current", "mv": "voltage", "v": "voltage", "g": "mass", "h": "time", "min": "time",
    "cycles": "count", "%": "share", "degc": "temperature", "°c": "temperature", "mohm": "impedance",
}


def finite(x: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def close(a: Column, b: Column, tolerance: Column | float = TOLERANCE) -> Column:
    """Whether two numbers differ by at most a share of the larger one."""
    limit = F.lit(tolerance) if isinstance(tolerance, float) else tolerance
    return F.abs(a - b) <= limit * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def unit_factor(unit: Column) -> Column:
    """The factor to the base unit; 1 for null and unknown units."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    out = F.lit(1.0)
    for name, factor in SMALL_UNITS.items():
        out = F.when(u == name, F.lit(factor)).otherwise(out)
    return out


def normalized(values: Column, unit: Column, prop: Column) -> Column:
    """Each value in the property's own unit; minutes become hours for properties whose name ends in _h."""
    minutes = (F.lower(F.trim(F.coalesce(unit, F.lit("")))) == "min") & prop.endswith("_h")
    factor = F.when(minutes, F.lit(1.0) / 60).otherwise(unit_factor(unit))
    return F.transform(values, lambda v: v * factor)


def unit_class(unit: Column) -> Column:
    """The physical class of a unit, or ``other:<unit>``."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in UNIT_CLASSES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, u), F.concat(F.lit("other:"), u))


def values_match(a: Column, a_unit: Column, b: Column, b_unit: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal arity, and sorted scaled values close one by one; null or empty arrays never match."""
    x = F.array_sort(F.transform(a, lambda v: v * unit_factor(a_unit)))
    y = F.array_sort(F.transform(b, lambda v: v * unit_factor(b_unit)))
    all_close = F.forall(F.zip_with(x, y, lambda p, q: F.coalesce(close(p, q, tolerance), F.lit(False))), lambda ok: ok)
    return F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0) & all_close, F.lit(False))


def comparable(a: Column, b: Column, tolerance: float = 0.2) -> Column:
    """Both given and within a share of the larger one."""
    return F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def in_numbers(x: Column, numbers: Column) -> Column:
    """Whether |x|, or a thousandfold of a small or large one, is close to some number's magnitude."""
    v = F.abs(x)

    def near(d: Column) -> Column:
        d = F.abs(d)
        return close(v, d) | ((v < 100) & close(v * 1000, d)) | ((v >= 1000) & close(v / 1000, d))

    return F.exists(numbers, near)


def similarity(a: Column, b: Column) -> Column:
    """1 / (1 + Euclidean distance) of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return 1 / (1 + F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)))


def relative_gap(measured: Column, claimed: Column) -> Column:
    """(measured - claimed) / |claimed|, null for a claim of 0."""
    return (measured - claimed) / F.nullif(F.abs(claimed), F.lit(0.0))
