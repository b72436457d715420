"""What a study asks around its models and claims: extraction units and replies, partial scores, compared configurations, paired
documents, flags for a person's review, composed answers, frozen edges, loaders that go on after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import names as nm
from attestor.functions import text as tx
from attestor.operators import claims, stats

# The fields of a grid cell that a reply has to name, rows and groups that metrics need, columns of frozen edges.
GRID_FIELDS = ("family", "axis_kind", "axis_value", "value")
LEAST_ROWS, LEAST_GROUPS = 20, 3
EDGES = ("view", "src", "dst", "weight", "same_group")


def extraction_units(regions: DataFrame) -> DataFrame:
    """(region_id, unit_id, kind, render): what is shown for each grid, and for each row of a specification table with a digit.

    ``regions`` has (region_id, kind, rows).  A specification's cell keeps its lines; regions of other kinds give nothing.
    """
    last = lambda r: F.coalesce(F.get(r, F.size(r) - 1), F.lit(""))
    grid = F.struct(F.concat("region_id", F.lit("_grid")).alias("unit_id"), F.lit("grid").alias("kind"), nm.rendered(F.col("rows")).alias("render"))

    def spec(row: Column, at: Column) -> Column:
        lines = F.filter(F.transform(F.split(F.when(F.size(row) > 1, last(row)).otherwise(""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
        body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x)), "\n")
        shown = F.concat(F.lit("Item: "), tx.flat(F.get(row, F.lit(0))), F.lit("\nSpecification:\n"), body)
        return F.when(last(row).rlike(r"\d"), F.struct(F.concat("region_id", F.lit("_r"), at.cast("string")).alias("unit_id"), F.lit("spec_row").alias("kind"), shown.alias("render")))

    rows = F.filter(F.transform("rows", spec), lambda u: u.isNotNull())
    units = F.when(F.col("kind") == "grid", F.array(grid)).when(F.col("kind") == "spec_table", rows).otherwise(F.slice(F.array(grid), 1, 0))
    return regions.select("region_id", F.explode(units).alias("u")).select("region_id", "u.*")


def grid_replies(replies: DataFrame, reply: str) -> DataFrame:
    """``replies`` with a row for each cell that a reply names: composed property, value, unit, and ``error`` where it is no claim.

    A reply without a readable array is ``no_list``; a cell lacking a field names it; values are held to the schema of claims.
    """
    cell = "struct<family:string,axis_kind:string,axis_value:string,value:string,unit:string>"
    block = tx.json_block(F.col(reply), "[", "]")
    parsed = F.when(block.isNotNull(), F.from_json(block, f"array<{cell}>"))
    rows = replies.select(*replies.columns, parsed.isNull().alias("none__"), F.explode_outer(parsed).alias("c"))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"c.{f}").isNull(), F.lit(f)) for f in GRID_FIELDS]))
    known = F.col("c.axis_kind").isin(*nm.AXES) & F.when(F.col("c.axis_kind") == "charge_mode", F.lower(F.trim("c.axis_value")).isin(*nm.CHARGE_MODES)).otherwise(F.col("c.axis_value").try_cast("double").isNotNull())
    error = (
        F.when(F.col("none__"), "no_list").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))).when(~F.col("c.family").isin(*nm.FAMILIES), "unknown_family")
        .when(~F.coalesce(known, F.lit(False)), "unknown_axis").when(F.size(claims.unnested(F.col("c.value"))) == 0, "malformed_value")
    )
    out = rows.withColumn("error", error)
    name = F.when(F.col("error").isNull(), nm.property_name(F.col("c.family"), F.col("c.axis_kind"), F.col("c.axis_value")))
    return out.select(*replies.columns, "error", name.alias("property"), F.col("c.value").alias("value"), F.col("c.unit").alias("unit"))


def partial_scores(matched: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, tp, fp, fn, precision, recall, f1, hallucinations, source_checks) by document.

    ``matched`` has (key, outcome, in_source): tp, fp or fn, and for a false positive whether the source holds its value.  Where ``sources`` (key,
    text) has no text, nothing that needs it is a number: hallucinations are null and ``source_checks`` says unavailable.
    """
    known = sources.where("text is not null").select(key, F.lit(True).alias("readable")).distinct()
    of = lambda k: F.count_if(F.col("outcome") == k)
    out = matched.groupBy(key).agg(of("tp").alias("tp"), of("fp").alias("fp"), of("fn").alias("fn"), F.count_if((F.col("outcome") == "fp") & ~F.coalesce("in_source", F.lit(False))).alias("absent"))
    both = out.join(known, key, "left").withColumn("readable", F.coalesce("readable", F.lit(False)))
    checks = F.when(F.col("readable"), "available").otherwise("unavailable")
    return both.select(key, "tp", "fp", "fn", *stats.scores(F.col("tp"), F.col("fp"), F.col("fn")), F.when(F.col("readable"), F.col("absent")).alias("hallucinations"), checks.alias("source_checks"))


def compared_configurations(gold: DataFrame, proposed: DataFrame, keys: list[str], steps: list[tuple[str, str]]) -> DataFrame:
    """(config, predicted, tp, fp, fn, precision, recall, f1, false_rejections, false_rejection_rate) of each configuration.

    ``gold`` has the distinct keys of true claims, ``proposed`` (config, keys).  ``steps`` are (config, the one it filters): a
    true claim of the latter that is gone is a false rejection.
    """
    truth = gold.select(*keys).distinct().withColumn("true__", F.lit(True))
    said = proposed.select("config", *keys).distinct().join(truth, keys, "left").withColumn("true__", F.coalesce("true__", F.lit(False)))
    n = gold.select(*keys).distinct().agg(F.count(F.lit(1)).alias("gold"))
    hit = said.groupBy("config").agg(F.count(F.lit(1)).alias("predicted"), F.count_if("true__").alias("tp")).join(F.broadcast(n))
    table = gold.sparkSession.createDataFrame(steps, "config string, before string")
    kept = said.where("true__").select("config", *keys, F.lit(True).alias("kept__"))
    lost = table.join(said.where("true__").withColumnRenamed("config", "before"), "before").join(kept, ["config", *keys], "left")
    gone = lost.groupBy("config").agg(F.count_if(F.col("kept__").isNull()).alias("false_rejections"), F.count(F.lit(1)).alias("offered"))
    out = hit.join(gone, "config", "left")
    fp, fn = F.col("predicted") - F.col("tp"), F.col("gold") - F.col("tp")
    return out.select("config", "predicted", "tp", fp.alias("fp"), fn.alias("fn"), *stats.scores(F.col("tp"), fp, fn), "false_rejections", F.try_divide("false_rejections", "offered").alias("false_rejection_rate"))


def paired_documents(reference: DataFrame, second: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """(key, n_reference, n_second) of documents that both annotators have; with ``strict`` a document that one lacks is an error."""
    count = lambda rows, name: rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(reference, "n_reference").join(count(second, "n_second"), key, "full")
    if strict:
        missing = [str(r[0]) for r in both.where("n_reference is null or n_second is null").select(key).orderBy(key).limit(20).collect()]
        if missing:
            raise FileNotFoundError(f"documents that one side lacks: {', '.join(missing)}")
    return both.where("n_reference is not null and n_second is not null")


def review_flags(instances: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """(flag, n, cells, recommendation): what a person should see before approving, one row for each rule that some cell meets.

    ``instances`` has a ``cell``; ``rules`` give a condition and a recommendation by name.  Up to twenty cells are listed.
    """
    marked = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("flag"), F.lit(advice).alias("recommendation"))) for name, (cond, advice) in rules.items()]))
    each = instances.select("cell", F.explode(marked).alias("f")).select("cell", "f.*")
    listed = F.array_join(F.transform(F.slice(F.array_sort(F.collect_set(F.col("cell"))), 1, 20), lambda c: c.cast("string")), ",")
    return each.groupBy("flag", "recommendation").agg(F.count(F.lit(1)).alias("n"), listed.alias("cells"))


def guarded_metrics(rows: DataFrame, variant: str, group: str, true: str, predicted: str) -> DataFrame:
    """(variant, n, groups, rmse, mape): errors by variant; with fewer than ``LEAST_ROWS`` rows or ``LEAST_GROUPS`` groups the counts alone."""
    rmse, mape, _ = stats.errors(F.col(true), F.col(predicted))
    out = rows.groupBy(variant).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("groups"), rmse, mape)
    enough = (F.col("n") >= LEAST_ROWS) & (F.col("groups") >= LEAST_GROUPS)
    return out.select(variant, "n", "groups", F.when(enough, F.col("rmse")).alias("rmse"), F.when(enough, F.col("mape")).alias("mape"))


def promises(models: DataFrame, claimed: DataFrame, measured: DataFrame, discrepancies: DataFrame, key: str) -> DataFrame:
    """One row for each model: what is claimed, how it is measured, and how far both are apart.

    ``claimed`` has (key, claim), ``measured`` (key, value), ``discrepancies`` (key, n, gap), computed earlier.  Raises where a stored gap
    rests on another number of measurements than there are now, as the answer would contradict itself.
    """
    said = claimed.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.min("claim").alias("least_claim"), F.max("claim").alias("most_claim"))
    facts = stats.distribution(measured, "value", key)
    both = models.select(key).distinct().join(said, key, "left").join(facts, key, "left").join(discrepancies.withColumnRenamed("n", "n_then"), key, "left")
    stale = F.col("n_then").isNotNull() & ~F.col("n_then").eqNullSafe(F.col("n"))
    gap = F.when(stale, F.raise_error(F.concat(F.lit("stored gap of "), F.col(key).cast("string"), F.lit(" rests on other measurements"))).cast("double")).otherwise(F.col("gap"))
    return both.select(key, F.coalesce("n_claims", F.lit(0)).alias("n_claims"), "least_claim", "most_claim", F.coalesce("n", F.lit(0)).alias("n"), "median", "q1", "q3", gap.alias("gap"))


def independent_measurements(rows: DataFrame, doc: str, order: str) -> DataFrame:
    """Rows (doc, property, value, conditions, ...) of another laboratory with ordinal ids within document and property, conditions
    without a value left out, rows without a value marked as shown in charts only."""
    from attestor.operators.store import ordinal_ids

    named = ordinal_ids(rows, [doc, "property"], [order], "measurement_id")
    held = F.map_filter(F.coalesce("conditions", F.create_map().cast("map<string,double>")), lambda k, v: v.isNotNull())
    return named.withColumns({"conditions": held, "chart_only": F.col("value").isNull()})


def checked_omissions(omitted: DataFrame, pages: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, property, verified): whether a property that a document is said to lack really occurs nowhere in its text.

    ``omitted`` has (doc, property), ``pages`` (doc, text), ``words`` (property, pattern).  A document without text verifies nothing.
    """
    asked = omitted.select("doc", "property").distinct().join(F.broadcast(words), "property", "left")
    met = asked.join(pages.where("text is not null").select("doc", "text"), "doc", "left")
    hit = F.coalesce(F.expr("text rlike pattern"), F.lit(False))
    seen = met.groupBy("doc", "property").agg(F.bool_or(hit).alias("hit"), F.count("text").alias("pages"), F.max("pattern").alias("pattern"))
    return seen.select("doc", "property", (~F.col("hit") & (F.col("pages") > 0) & F.col("pattern").isNotNull()).alias("verified"))


def neighbourhood(edges: DataFrame, view: str, center: int, k: int, names: DataFrame) -> DataFrame:
    """(rank, dst, weight, name): the k best edges of one centre in one view; an unknown view, centre or k is an error."""
    from attestor.operators.graph import top_edges

    if not 1 <= k <= 50:
        raise ValueError(f"k has to be from 1 to 50, not {k}")
    own = edges.where((F.col("view") == view) & (F.col("src") == center))
    if own.isEmpty():
        raise KeyError(f"no edges of {center} in the view {view}")
    from pyspark.sql import Window

    best = top_edges(own, k).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")))
    return best.join(names.select(F.col("id").alias("dst"), "name"), "dst", "left").select("rank", "dst", "weight", "name")


def frozen_edges(edges: DataFrame, folder: str) -> DataFrame:
    """The edges of a publication: written once by view, then always read as they were, in a fixed order of columns."""
    spark = edges.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        edges.select(*EDGES).write.partitionBy("view").parquet(folder)
    types = dict(edges.dtypes)
    return spark.read.schema(", ".join(f"{c} {types[c]}" for c in EDGES)).parquet(folder).select(*EDGES)


def loaded(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame | None]], folder: str) -> DataFrame:
    """(study, state, detail): every loader is run and stored; one without data is skipped, one that fails is reported, the rest go on."""
    out = []
    for name, load in loaders.items():
        try:
            rows = load()
            if rows is None:
                out.append((name, "skipped", "no data"))
                continue
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
            out.append((name, "loaded", str(spark.read.parquet(f"{folder}/{name}").count())))
        except Exception as e:  # noqa: BLE001  a study that fails must not stop the others
            out.append((name, "failed", type(e).__name__))
    return spark.createDataFrame(out, "study string, state string, detail string")
