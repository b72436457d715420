"""Claims against measurements and against each other: gaps, verdicts, nearest conditions, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.functions.values import close, comparable, in_numbers, relative_gap, unit_factor
from attestor.operators.stats import distribution

# Plausible ranges of properties in their own units.
BOUNDS = {
    "nominal_capacity_ah": (0.1, 10), "minimum_capacity_ah": (0.1, 10), "rated_capacity_ah": (0.1, 10), "initial_capacity_ah": (0.1, 10),
    "nominal_voltage_v": (0, 5), "charge_voltage_v": (0, 5), "max_charge_voltage_v": (0, 5), "discharge_cutoff_v": (0, 5), "charge_cutoff_v": (0, 5),
    "std_charge_current_a": (0.01, 100), "fast_charge_current_a": (0.01, 100), "max_charge_current_a": (0.01, 100), "std_discharge_current_a": (0.01, 100),
    "fast_discharge_current_a": (0.01, 100), "max_cont_discharge_a": (0.01, 100), "max_pulse_discharge_a": (0.01, 200), "max_cont_discharge_c": (0.05, 100),
    "cycle_life_cycles": (1, 20000), "cycle_life_retention_pct": (0, 100), "storage_capacity_remaining_pct": (0, 100), "storage_capacity_recovery_pct": (0, 100),
    "capacity_retention_at_temp_pct": (0, 100), "mass_g": (10, 100), "charge_temp_range_c": (-60, 100), "discharge_temp_range_c": (-60, 100),
    "storage_temp_range_c": (-60, 100), "operating_temp_range_c": (-60, 100), "internal_impedance_mohm": (0.1, 1000), "volumetric_energy_density_wh_l": (50, 2000),
    "gravimetric_energy_density_wh_kg": (30, 500), "std_charge_time_h": (0.05, 50),
}


def claim_gaps(claims: DataFrame, measured: DataFrame, key: str, claimed: str, value: str) -> DataFrame:
    """Claims with the distribution of the measured values of their key and the gap of its median."""
    facts = distribution(measured, value, key)
    return claims.join(facts, key).withColumn("gap", relative_gap(F.col("median"), F.col(claimed)))


def nearest_condition(claims: DataFrame, measured: DataFrame, key: str, claim_at: str, measured_at: str, order: Sequence[str], tolerance: float = 0.2) -> DataFrame:
    """Each claim (with an ``id``) and the measurement of its key whose condition is nearest.

    A measurement without a condition stands far away; a claim without one takes the smallest condition.  ``order`` breaks
    ties.  ``comparable`` says whether both conditions are given and close.
    """
    far = F.coalesce(measured_at, F.lit(1e9))
    distance = F.when(F.col(claim_at).isNull(), far).otherwise(F.abs(far - F.col(claim_at)))
    w = Window.partitionBy("id").orderBy("distance__", *order)
    best = claims.join(measured, key).withColumn("distance__", distance).withColumn("nth__", F.row_number().over(w)).where("nth__ = 1")
    return best.withColumn("comparable", comparable(F.col(claim_at), F.col(measured_at), tolerance)).drop("nth__", "distance__")


def condition_mismatches(a: Column, b: Column, tolerance: Column | float = 0.02) -> Column:
    """The sorted names of conditions (maps of numbers) that both sides give and that are not close."""
    shared = F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))
    return F.filter(shared, lambda k: ~close(F.element_at(a, k), F.element_at(b, k), tolerance))


def verdict(a: Column, a_conditions: Column, a_text: Column, b: Column, b_conditions: Column, b_text: Column, tolerance: Column | float = 0.02) -> Column:
    """consistent, condition_mismatch or document_variant_conflict for two claims (values are arrays of one or two).

    Equal values need equal conditions.  Otherwise a single value may satisfy the other side's bound, if the two sides
    don't state the same kind of bound.
    """
    return judged(a, F.size(condition_mismatches(a_conditions, b_conditions, tolerance)) > 0, tx.bound(a_text), b, tx.bound(b_text), tolerance)


def judged(a: Column, mismatch: Column, up: Column, b: Column, down: Column, tolerance: Column | float = 0.02) -> Column:
    """``verdict`` of claims of which is known whether conditions differ, and the bounds of their texts: upper, lower or null."""
    limit = F.lit(tolerance) if isinstance(tolerance, float) else tolerance
    both_points = (F.size(a) == 1) & (F.size(b) == 1)
    alike = (F.size(a) == F.size(b)) & F.forall(F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.coalesce(close(x, y, limit), F.lit(False))), lambda ok: ok)
    equal = F.when(both_points, F.coalesce(close(F.get(a, F.lit(0)), F.get(b, F.lit(0)), limit), F.lit(False))).otherwise(alike)  # points need no arrays

    def meets(x: Column, bound: Column, y: Column) -> Column:
        x, y = F.get(x, F.lit(0)), F.get(y, F.lit(0))
        return ((bound == "upper") & (y <= x * (1 + limit))) | ((bound == "lower") & (y >= x * (1 - limit)))

    other = ~up.eqNullSafe(down)
    ok = both_points & other & ((up.isNotNull() & meets(a, up, b)) | (down.isNotNull() & meets(b, down, a)))
    return (
        F.when(equal & mismatch, "condition_mismatch")
        .when(equal, "consistent")
        .when(F.coalesce(ok, F.lit(False)), "consistent")
        .otherwise("document_variant_conflict")
    )


def bounds_table(spark) -> DataFrame:
    return spark.createDataFrame([(p, float(lo), float(hi)) for p, (lo, hi) in BOUNDS.items()], "property string, lo double, hi double")


def unnested(value: Column) -> Column:
    """array<array<double>> of the claims that a raw value (JSON text) holds; empty if it is malformed.

    A number is one claim, a pair is a range, longer lists are one claim for each number, lists of pairs one per pair.
    """
    number = value.rlike(r"^\s*-?\d+(\.\d+)?([eE][-+]?\d+)?\s*$")
    flat = F.from_json(value, "array<double>")
    nested = F.from_json(value, "array<array<double>>")
    is_flat = value.rlike(r"^\s*\[[^\[\]\"a-zA-Z]*\]\s*$") & (F.size(flat) > 0) & F.forall(flat, lambda x: x.isNotNull())
    is_nested = value.rlike(r"^\s*\[\s*\[") & (F.size(nested) > 0) & F.forall(nested, lambda x: (F.size(x) == 2) & F.forall(x, lambda y: y.isNotNull()))
    none = F.array().cast("array<array<double>>")
    return F.coalesce(
        F.when(number, F.array(F.array(value.cast("double"))))
        .when(is_flat & (F.size(flat) == 2), F.array(flat))
        .when(is_flat & (F.size(flat) > 2), F.transform(flat, lambda x: F.array(x)))
        .when(is_nested, nested),
        none,
    )


def validated(claims: DataFrame, documents: DataFrame, doc: str, text: str) -> DataFrame:
    """Claims (doc, property, value as JSON text, unit) after four stages, with ``reason`` null if accepted.

    Schema: unnested into one row for each claim, or rejected as malformed or incomplete.  Source: every number must occur
    in the document.  Bounds: every scaled number must be plausible for the property, unknown ones pass.  Tolerance: a
    range that the document states as X ± Y becomes X.
    """
    parts = claims.withColumn("parts__", unnested(F.col("value")))
    shape = F.when(F.col("property").isNull() | F.col("value").isNull(), "missing_field").when(F.size("parts__") == 0, "malformed_value")
    one = parts.withColumn("shape__", shape).withColumn("v", F.explode(F.when(F.size("parts__") == 0, F.array(F.lit(None).cast("array<double>"))).otherwise(F.col("parts__"))))
    docs = documents.select(F.col(doc), tx.numbers(F.col(text)).alias("numbers__"), tx.plus_minus(F.col(text)).alias("pm__"))
    known = one.join(docs, doc, "left").join(F.broadcast(bounds_table(claims.sparkSession)), "property", "left")
    in_source = F.forall("v", lambda x: F.coalesce(in_numbers(x, F.col("numbers__")), F.lit(False)))
    scaled = F.transform("v", lambda x: x * unit_factor(F.col("unit")))
    sane = F.col("lo").isNull() | F.forall(scaled, lambda x: x.between(F.col("lo"), F.col("hi")))
    reason = F.coalesce("shape__", F.when(~in_source, "value_not_in_source"), F.when(~sane, "implausible"))
    out = known.withColumn("reason", reason)
    return with_tolerance(out, "v", "pm__").select(*claims.columns, "v", "reason", "normalized")


def with_tolerance(rows: DataFrame, v: str, pm: str) -> DataFrame:
    """``rows`` with ``v`` reduced to X where it is a range that some ``X ± Y`` in ``pm`` states, and ``normalized``."""
    lo, hi = F.array_min(v), F.array_max(v)
    fits = F.filter(pm, lambda p: close((lo + hi) / 2, p["x"]) & close((hi - lo) / 2, p["y"], 0.05))
    hit = (F.size(v) == 2) & F.coalesce(F.size(fits) > 0, F.lit(False))
    accepted = F.col("reason").isNull() if "reason" in rows.columns else F.lit(True)
    return rows.withColumn("normalized", hit & accepted).withColumn(v, F.when(F.col("normalized"), F.array(F.get(fits, F.lit(0))["x"])).otherwise(F.col(v)))
