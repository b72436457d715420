"""Rows joined with the one of their key whose value is nearest, in both directions, and texts that begin with a known prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.storage import stored


def nearest_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str = "value") -> DataFrame:
    """(id, pos): for each left row (keys, id, value) the right row (keys, pos, value) of its key with the nearest value.

    Of equally near ones the first by pos.  A left row without a value takes the first of those with one; where none of a key's
    rows has one, the first row of all; without rows of its key pos is null.  Both sides are merged by value: each
    left row sees the last right value before it and the next one after it, so no pairs are formed.
    """
    keys = list(keys)
    value = F.col(at).cast("double")
    firsts = right.groupBy(*keys).agg(F.min("pos").alias("any_pos"), F.min(F.when(value.isNotNull(), F.col("pos"))).alias("first_pos"))
    # of equal values only the first position can be the answer
    known = right.where(value.isNotNull()).groupBy(*keys, value.alias("v")).agg(F.min("pos").alias("pos"))
    asked = left.where(value.isNotNull()).select(*keys, value.alias("v"), "id", F.lit(None).cast("long").alias("pos"), F.lit(1).alias("side"))
    both = known.select(*keys, "v", F.lit(None).cast(dict(left.dtypes)["id"]).alias("id"), F.col("pos").cast("long").alias("pos"), F.lit(0).alias("side")).unionByName(asked)
    held = F.when(F.col("side") == 0, F.struct("v", "pos"))
    rows = Window.unboundedPreceding, 0
    up = Window.partitionBy(*keys).orderBy("v", "side").rowsBetween(*rows)
    down = Window.partitionBy(*keys).orderBy(F.desc("v"), "side").rowsBetween(*rows)
    seen = both.withColumns({"below": F.last(held, ignorenulls=True).over(up), "above": F.last(held, ignorenulls=True).over(down)}).where("side = 1")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col("v")).alias("d"), F.col(f"{c}.pos").alias("pos")))
    best = seen.select("id", F.array_min(F.array_compact(F.array(near("below"), near("above"))))["pos"].alias("near_pos"))
    out = left.select("id", *keys).join(firsts, keys, "left").join(best, "id", "left")
    return out.select("id", F.coalesce("near_pos", "first_pos", "any_pos").alias("pos"))


def claim_conditions(asked: DataFrame, claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, pos, conditions): the conditions of the claim that is nearest in value.

    ``asked`` has (keys, id, value), ``claims`` (keys, pos, value array, unit_factor, conditions, end_condition); ranges have no
    single value and are taken only where a key has nothing else.  A percentage in the end condition counts as retention_pct.
    """
    from attestor.functions.text import first_percent

    single = F.when(F.size("value") == 1, F.get("value", F.lit(0)) * F.col("unit_factor"))
    found = nearest_rows(asked, claims.withColumn("value", single), keys)
    retention = first_percent(F.coalesce("end_condition", F.lit("")))
    given = F.map_filter("conditions", lambda k, v: v.isNotNull() & ((k != "retention_pct") | retention.isNull()))
    held = F.when(retention.isNotNull(), F.map_concat(given, F.create_map(F.lit("retention_pct"), retention))).otherwise(given)
    both = asked.select("id", *keys).join(found, "id").join(claims.select(*keys, "pos", held.alias("held")), [*keys, "pos"], "left")
    return both.select("id", "pos", F.coalesce("held", F.create_map().cast("map<string,double>")).alias("conditions"))


def beginning_with(rows: DataFrame, prefix: str, lines: DataFrame, line: str) -> DataFrame:
    """``rows`` whose prefix some line begins with.

    There are few lengths of prefixes; a line gives one key for each length that it reaches, and keys are joined by equality.
    """
    lengths = rows.select(F.char_length(prefix).alias("n")).where("n is not null").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    cut = F.transform(F.filter("lengths", lambda n: n <= F.char_length(line)), lambda n: F.substr(F.col(line), F.lit(1), n))
    keys = lines.where(F.col(line).isNotNull()).select(line).join(F.broadcast(lengths)).select(F.explode(cut).alias(prefix)).distinct()
    return rows.join(keys, prefix, "left_semi").select(rows.columns)


def missed_causes(gold: DataFrame, proposed: DataFrame, rejected: DataFrame, numbers: Column, match: Column) -> DataFrame:
    """(id, cause, detail) of each missed claim: just one cause, the first that holds.

    ``gold`` has (id, property, value, unit) and whatever ``numbers`` reads, the numbers of the source as an array; ``proposed`` (run,
    property, p_value, p_unit); ``rejected`` (property, reason).  ``match`` says whether a proposed claim equals the gold one.
    ocr_value_lost: the source doesn't hold the value; validator_rejected: proposed, and claims of its property were rejected;
    consensus_dropped: proposed by some runs; wrong_value: the property with other values; not_extracted: never proposed.
    """
    from attestor.functions.values import in_numbers
    from attestor.operators.matching import joined

    in_source = F.forall("value", lambda v: F.coalesce(in_numbers(v, numbers), F.lit(False)))
    base = gold.withColumn("in_source", in_source)
    said = stored(proposed.groupBy("property", "p_value", "p_unit").agg(F.collect_set("run").alias("runs")), "said")
    # equal claims are compared once with what was proposed, and what was proposed of a property is listed once
    claim = ["property", "value", "unit"]
    each = gold.select(*claim).distinct().join(said, "property").where(match)
    met = each.groupBy(*claim).agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("met"))
    listed_values = F.array_sort(F.collect_set(F.array_join(F.transform("p_value", lambda v: v.cast("string")), "..")))
    seen = said.groupBy("property").agg(listed_values.alias("values"))
    runs = F.array_sort(F.array_distinct(F.flatten(F.collect_list("met").over(Window.partitionBy("id")))))
    base = joined(base, stored(met, "met"), claim, "left").withColumn("in_runs", F.when(F.col("id").isNotNull(), runs)).drop("met")
    reasons = rejected.groupBy("property").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    both = base.join(stored(seen, "values"), "property", "left").join(reasons, "property", "left")
    proposed_at_all, hit = F.col("values").isNotNull(), F.coalesce(F.size("in_runs"), F.lit(0)) > 0
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    cause = (
        F.when(~F.col("in_source"), "ocr_value_lost").when(hit & F.col("reasons").isNotNull(), "validator_rejected").when(hit, "consensus_dropped")
        .when(proposed_at_all, "wrong_value").otherwise("not_extracted")
    )
    detail = (
        F.when(F.col("cause") == "validator_rejected", F.concat(F.lit("runs "), listed("in_runs"), F.lit(": "), listed("reasons"))).when(F.col("cause") == "consensus_dropped", F.concat(F.lit("runs "), listed("in_runs")))
        .when(F.col("cause") == "wrong_value", F.concat(F.lit("values "), listed("values"))).otherwise("")
    )
    return both.withColumn("cause", cause).withColumn("detail", detail).select("id", "cause", "detail")


def subset_recall(subset: DataFrame, predicted: DataFrame, exact: bool) -> DataFrame:
    """(n, hits, recall): how many claims of a subset, in order, find a free prediction of their property, or unit class, and value.

    Both sides have (property, unit, value, pos); values are scaled to base units.
    """
    from attestor.functions.values import unit_class, unit_factor
    from attestor.operators.matching import gold_order

    kind = F.col("property") if exact else unit_class(F.col("unit"))
    keyed = lambda rows: rows.select(kind.alias("kind"), "pos", (F.col("value") * unit_factor(F.col("unit"))).alias("value"))
    found = gold_order(keyed(subset), keyed(predicted), ["kind"]).where("g is not null")
    out = found.agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("hits"))
    return out.select("n", "hits", F.round(F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)), 4).alias("recall"))
