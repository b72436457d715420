"""Specification lines as entries: an ordered list of rules, of which the first one that a line meets says what it holds.

A rule is data: a pattern and the entries that it gives, each with the groups of its values, of its unit and of its
conditions.  ``entries`` builds one expression from the rules, ``entries_sql`` the same in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.values import normalized


@dataclass(frozen=True)
class Entry:
    """One entry: ``values`` are groups (with the group of a unit for each, or the unit itself); without ``needed`` it is left out."""

    prop: str
    values: tuple[int, ...]
    units: tuple[int | str, ...] = ("",)
    conditions: dict[str, int] = field(default_factory=dict)
    needed: int | None = None


# The patterns of specification lines in order, with the properties that they state.
RULES: list[tuple[str, tuple[Entry, ...]]] = [
    (
        r"(?:Nominal|Real) capacity(?: & voltage)?:\s*(?:NCR )?([\d.,]+)\s*(mAh|Ah)(?:,\s*([\d.]+)\s*v)?",
        (Entry("nominal_capacity_ah", (1,), (2,)), Entry("nominal_voltage_v", (3,), ("V",), needed=3)),
    ),
    (r"Nominal voltage:\s*([\d.]+)\s*V", (Entry("nominal_voltage_v", (1,), ("V",)),)),
    (
        r"standard charge(?: method)?:\s*([\d.,]+)\s*(mA|A)\b(?:,\s*|\s+to\s+)([\d.]+)\s*V",
        (Entry("std_charge_current_a", (1,), (2,), {"charge_voltage_v": 3}),),
    ),
    (r"fast charge(?: current)?:\s*([\d.,]+)\s*(mA|A)\b", (Entry("fast_charge_current_a", (1,), (2,)),)),
    (r"Max\.? charge voltage:\s*([\d.]+)\s*V", (Entry("max_charge_voltage_v", (1,), ("V",)),)),
    (r"Max\.? charge current:\s*([\d.,]+)\s*(mA|A)\b", (Entry("max_charge_current_a", (1,), (2,)),)),
    (
        r"Standard discharge:\s*([\d.,]+)\s*(mA|A)\b.*?([\d.]+)\s*V",
        (Entry("std_discharge_current_a", (1,), (2,), {"discharge_cutoff_v": 3}),),
    ),
    (r"Fast discharge:\s*([\d.,]+)\s*(mA|A),\s*([\d.,]+)\s*(mA|A)", (Entry("fast_discharge_current_a", (1, 3), (2, 4)),)),
    (r"Max\.?(?:imum)? continuous discharge:\s*([\d.,]+)\s*(mA|A)\b", (Entry("max_cont_discharge_a", (1,), (2,)),)),
    (r"Pulse discharge.*?:\s*([\d.,]+)\s*A", (Entry("max_pulse_discharge_a", (1,), ("A",)),)),
    (
        r"Cycle life at ([\d.]+)C discharge,\s*([\d.]+)% DOD:\s*(?:Over\s*)?([\d.,]+)\s*cycles",
        (Entry("cycle_life_cycles", (3,), ("cycles",), {"discharge_c_rate": 1, "dod_pct": 2}),),
    ),
    (
        r"Cycle life:\s*([\d.,]+)\s*at\s*([\d.]+)A,\s*([\d.,]+)\s*at\s*([\d.]+)A.*?([\d.]+)A charge.*?([\d.]+)\s*%",
        (
            Entry("cycle_life_cycles", (1,), ("cycles",), {"discharge_current_a": 2, "charge_current_a": 5, "retention_pct": 6}),
            Entry("cycle_life_cycles", (3,), ("cycles",), {"discharge_current_a": 4, "charge_current_a": 5, "retention_pct": 6}),
        ),
    ),
    (r"(?:Cell )?(?:Net)?weight:?\s*(?:Max\.?\s*)?([\d.]+)\s*g", (Entry("mass_g", (1,), ("g",)),)),
    (
        r"charge/cut-?off voltage:\s*([\d.]+)\s*v\s*to\s*([\d.]+)\s*v",
        (Entry("charge_voltage_v", (1,), ("V",)), Entry("discharge_cutoff_v", (2,), ("V",))),
    ),
    (
        r"Cut off at ([\d.]+)\s*V(?:,\s*full charge\s*([\d.]+)\s*V)?",
        (Entry("discharge_cutoff_v", (1,), ("V",)), Entry("charge_voltage_v", (2,), ("V",), needed=2)),
    ),
    (
        r"Operating temp(?:erature)?:?\s*(?:charge\s*)?(-?\d+)\s*°?C?\s*~\s*\+?(-?\d+)(?:°C|degC)?.*?discharge:?\s*(-?\d+)\s*°?C?\s*~\s*\+?(-?\d+)",
        (Entry("charge_temp_range_c", (1, 2), ("degC", "degC")), Entry("discharge_temp_range_c", (3, 4), ("degC", "degC"))),
    ),
    (
        r"Operating temp(?:erature)?:?\s*(?:charge\s*)?(-?\d+)\s*°?C?\s*~\s*\+?(-?\d+)(?:°C|degC)?",
        (Entry("operating_temp_range_c", (1, 2), ("degC", "degC")),),
    ),
    (
        r"Storage temperature:.*?1 year:\s*(-?\d+)\s*°?C?\s*~\s*\+?(-?\d+)",
        (Entry("storage_temp_range_c", (1, 2), ("degC", "degC")),),
    ),
]
SCHEMA = "array<struct<rule:int,property:string,value:array<double>,conditions:map<string,double>>>"


def entries(line: Column) -> Column:
    """``SCHEMA``: the entries of the first rule that a line meets; empty if it meets none.

    Numbers lose their thousands separators; one that still can't be read is null.  Conditions without a number are left out.
    """
    text = F.trim(line)
    out = F.array().cast(SCHEMA)
    for k, (pattern, given) in reversed([*enumerate(RULES, 1)]):
        pattern = "(?i)" + pattern
        group = lambda g, pattern=pattern: F.regexp_extract(text, pattern, g)
        number = lambda g, group=group: F.replace(group(g), F.lit(","), F.lit("")).try_cast("double")
        made = []
        for e in given:
            value = F.array(*[normalized(F.array(number(g)), group(u) if isinstance(u, int) else F.lit(u), F.lit(e.prop))[0] for g, u in zip(e.values, e.units, strict=True)])
            pairs = [F.struct(F.lit(name).alias("key"), number(g).alias("value")) for name, g in e.conditions.items()]
            held = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast("map<string,double>")
            entry = F.struct(F.lit(k).alias("rule"), F.lit(e.prop).alias("property"), value.alias("value"), held.alias("conditions"))
            made.append(F.when(group(e.needed) != "", entry) if e.needed else entry)
        out = F.when(text.rlike(pattern), F.filter(F.array(*made), lambda x: x.isNotNull()).cast(SCHEMA)).otherwise(out)
    return F.coalesce(out, F.array().cast(SCHEMA))


def entries_sql(lines: str, key: str) -> str:
    """SQL over the table ``lines`` (key, line): (key, rule, pos, property, v0, v1, conditions) of every entry."""
    quoted = [("(?i)" + p).replace("'", "''") for p, _ in RULES]
    first = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN {k}" for k, p in enumerate(quoted, 1)) + " END"
    parts = []
    for k, (p, (_, given)) in enumerate(zip(quoted, RULES, strict=True), 1):
        number = lambda g, p=p: f"try_cast(replace(regexp_extract(line, '{p}', {g}), ',', '') AS DOUBLE)"
        for pos, e in enumerate(given):
            scaled = []
            for g, u in zip(e.values, e.units, strict=True):
                factor = f"CASE WHEN lower(regexp_extract(line, '{p}', {u})) IN ('mah', 'ma', 'mv') THEN 0.001::DOUBLE ELSE 1 END" if isinstance(u, int) else "1"
                scaled.append(f"{number(g)} * {factor}")
            held = ", ".join(f"'{name}=' || round({number(g)}, 6)" for name, g in sorted(e.conditions.items()))
            where = f" AND regexp_extract(line, '{p}', {e.needed}) <> ''" if e.needed else ""
            parts.append(
                f"SELECT {key}, {k} AS rule, {pos} AS pos, '{e.prop}' AS property, round({scaled[0]}, 6) AS v0, "
                f"{f'round({scaled[1]}, 6)' if len(scaled) > 1 else 'NULL::DOUBLE'} AS v1, {f'concat_ws({chr(39)};{chr(39)}, {held})' if held else chr(39) * 2} AS conditions FROM ruled WHERE rule = {k}{where}"
            )
    return f"ruled AS (SELECT *, {first} AS rule FROM {lines}), entries AS ({' UNION ALL '.join(parts)})"
