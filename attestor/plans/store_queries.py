"""Queries over entities and paths (TPC-H tables as a graph), claims against measurements, and verdicts.

region-nation-customer-order-lineitem are the hops of the graph; a part is a product model, its retail price the claim,
prices per unit sold the measurements, and suppliers the documents that state values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions.values import close
from attestor.operators import claims, matching, stats, store
from attestor.plans.common import rounded, table

TOLERANCES = [0.0, 0.005, 0.02, 0.05, 0.5]
LABELS = ("region", "nation", "customer", "supplier", "part", "orders")


def graph_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by label."""
    return store.counts_by(spark, {n: table(spark, folder, n) for n in LABELS})


def relationship_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by kind and by source, sources without edges included."""
    n, c = table(spark, folder, "nation"), table(spark, folder, "customer")
    counted = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.min("c_acctbal").alias("least_balance"), F.percentile("c_acctbal", F.lit(0.5)).alias("median_balance"))
    return rounded(counted)


def path_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct customers with orders on three-hop paths from each region."""
    o = table(spark, folder, "orders").select("o_custkey").distinct()
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(o, F.col("c_custkey") == F.col("o_custkey"))
    paths = table(spark, folder, "region").join(table(spark, folder, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"))
    return paths.groupBy("r_name").agg(F.countDistinct("c_custkey").alias("n"))


def measurement_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Measurement to instance to model: quantities per market segment."""
    l, o, c = (table(spark, folder, n) for n in ("lineitem", "orders", "customer"))
    both = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(both.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount")))


def claims_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Claims (suppliers) of the sources (nations) of one region, in order."""
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation").where("n_regionkey = 1")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_name", F.round("s_acctbal", 6).alias("balance")).orderBy("n_name", "s_suppkey")


def predicate_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose name holds a text, by brand."""
    p = table(spark, folder, "part").where(F.col("p_name").contains("gear") & F.col("p_type").isNotNull())
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One entity by its key."""
    return table(spark, folder, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


def problem_order(spark: SparkSession, folder: str) -> DataFrame:
    """The ten dearest problem rows: open ones first, then by price and key."""
    o = table(spark, folder, "orders")
    key = (F.col("o_orderstatus") != "O").cast("int")
    return o.orderBy(key, F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 6).alias("price"))


def claim_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of claims: source, property and number, counted with their extremes per source."""
    l = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("property"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey", "l_shipdate")
    ids = store.ordinal_ids(l, ["source", "property"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"])
    return ids.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def instance_measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Three measurements for each order; values that weren't reached are censored."""
    o = table(spark, folder, "orders")
    done = F.col("o_orderstatus") == "F"
    rows = store.measurement_rows(o, "o_orderkey", {"price": (F.col("o_totalprice"), done, "eur"), "year": (F.year("o_orderdate").cast("double"), F.lit(True), "a"), "urgent": (F.length("o_orderpriority").cast("double"), F.col("o_orderpriority").startswith("1"), "n")})
    return rounded(rows.groupBy("metric", "unit", "censored").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.countDistinct("id").alias("ids")))


def upsert_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Customers updated by orders' customers: new balances win unless null, segments stay as they were."""
    c = table(spark, folder, "customer").select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")
    new = c.where("c_mktsegment like '%A%'").select((F.col("c_custkey") + 1).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.lit(1.5)).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return store.upsert(c, new, "c_custkey", keep_old=["c_mktsegment"])


def load_idempotent(spark: SparkSession, folder: str) -> DataFrame:
    """The same update twice leaves what it left once."""
    c = table(spark, folder, "customer").select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")
    new = c.where("c_acctbal < 0").select((F.col("c_custkey") + 2).alias("c_custkey"), F.lit(2.5).alias("c_acctbal"), F.lit("X").alias("c_mktsegment"))
    twice = store.upsert(store.upsert(c, new, "c_custkey"), new, "c_custkey")
    return twice.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 4).alias("balance"))


def part_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of one view replaced for some sources, others untouched."""
    l = table(spark, folder, "lineitem")
    e = l.select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("view"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    new = e.where("src % 10 = 0").select(F.lit("condition").alias("view"), "src", (F.col("dst") + 1).alias("dst")).distinct()
    out = store.replace_part(e, new, new.select("src"), "condition")
    return out.groupBy(F.coalesce("view", F.lit("none")).alias("view")).agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("total"))


def unique_keys(spark: SparkSession, folder: str) -> DataFrame:
    """How many keys of each label repeat."""
    from attestor.schemas import repeated_keys

    keys = {"customer": ("c_custkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber")}
    return store.counts_by(spark, {t: repeated_keys(table(spark, folder, t), *k) for t, k in keys.items()})


def set_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that both, only the first or only the second side has."""
    n = table(spark, folder, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("k"))
    c = table(spark, folder, "customer").where("c_acctbal < 0 and c_nationkey < 20").select(F.col("c_nationkey").alias("k")).distinct()
    return store.counts_by(spark, {"both": n.intersect(c), "first_only": n.exceptAll(c), "second_only": c.exceptAll(n)})


def gold_diff(spark: SparkSession, folder: str) -> DataFrame:
    """What changed between two versions of a claim set: added, removed, renamed or with other conditions."""
    v1 = table(spark, folder, "part").where("p_size <> 3").select(F.col("p_partkey").alias("key"), "p_brand", F.round("p_retailprice", 2).alias("price"), "p_size")
    v2 = table(spark, folder, "part").where("p_size <> 4").select(
        F.when(F.col("p_size") == 5, -F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("key"), "p_brand", F.round("p_retailprice", 2).alias("price"),
        F.when(F.col("p_size") == 6, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"),
    )
    a, b = v1.alias("a"), v2.alias("b")
    j = a.join(b, "key", "full_outer").select("key", F.col("a.p_brand").alias("b1"), F.col("a.price").alias("v1"), F.col("a.p_size").alias("s1"), F.col("b.p_brand").alias("b2"), F.col("b.price").alias("v2"), F.col("b.p_size").alias("s2"))
    gone, came = j.where("b2 is null"), j.where("b1 is null")
    renamed = gone.select(F.col("b1"), F.col("v1"), F.col("s1"), F.abs("key").alias("id")).join(came.select("b2", "v2", "s2", F.abs("key").alias("id")), "id").where("b1 = b2 and v1 = v2 and s1 = s2")
    return store.counts_by(spark, {"added": came, "removed": gone, "renamed": renamed, "conditions_changed": j.where("b1 is not null and b2 is not null and s1 <> s2")})


def _prices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax")


def measured_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """n, median, extremes and quartiles of the measured prices of each brand."""
    both = _prices(spark, folder).join(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey")
    return rounded(stats.distribution(both, "price", "p_brand"))


def claim_vs_measured(spark: SparkSession, folder: str) -> DataFrame:
    """Claimed price of each part against what was measured."""
    p = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    out = claims.claim_gaps(p, _prices(spark, folder), "p_partkey", "p_retailprice", "price")
    return rounded(out.select("p_partkey", "n", "median", "q1", "q3", "gap"), 8)


def nearest_condition_claim(spark: SparkSession, folder: str) -> DataFrame:
    """Each part's claim and the measurement whose quantity is nearest to the part's size."""
    p = table(spark, folder, "part").select("p_partkey", F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("double")).alias("claim_at"), "p_retailprice")
    m = _prices(spark, folder).withColumn("measured_at", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")))
    best = claims.nearest_condition(p, m, "p_partkey", "claim_at", "measured_at", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(best.select("id", "claim_at", "measured_at", "comparable", ((F.col("price") - F.col("p_retailprice")) / F.col("p_retailprice")).alias("gap")))


#: Line items in a partition of pairs.
DEALT = 1_000_000
_TEXTS = ("Max. value", "min. 5 A", "typical", "over 3")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of two suppliers on one part, paired by rank: values, conditions and texts."""
    l = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_linenumber")
    # partitions of bounded size, so that a task's memory does not grow with the table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-l.count() // DEALT))
    one = l.repartition(parts, "l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("v"), F.max("l_discount").alias("d"), F.max("l_linenumber").cast("double").alias("c"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("l_partkey").orderBy("l_suppkey")
    nxt = {c: F.lead(c).over(w) for c in ("l_suppkey", "v", "c", "n")}
    first = one.select("*", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("l_partkey")).alias("of"), *[x.alias(f"next_{c}") for c, x in nxt.items()]).where("r = 1 and of > 1")
    text = lambda c: F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col(c) % 4 + 1).cast("int"))
    cond = lambda c, n: F.create_map(F.lit("current"), c, F.lit("n"), F.col(n).cast("double"))
    return first.select(
        "l_partkey", F.array("v").alias("a_value"), cond("c", "n").alias("a_cond"), text("l_suppkey").alias("a_text"),
        F.array("next_v").alias("b_value"), cond("next_c", "next_n").alias("b_cond"), text("next_l_suppkey").alias("b_text"),
    ).where("l_partkey is not null")


def _verdicts(rows: DataFrame, tolerance=0.02) -> DataFrame:
    v = claims.verdict(*[F.col(f"{s}_{c}") for s in "ab" for c in ("value", "cond", "text")], tolerance)
    return rows.withColumn("verdict", v)


def spec_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of each pair of claims, with the names of the conditions that differ."""
    out = _verdicts(_pairs(spark, folder))
    return out.select("l_partkey", "verdict", F.array_join(claims.condition_mismatches(F.col("a_cond"), F.col("b_cond")), ",").alias("differing"))


def spec_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts counted by brand."""
    out = _verdicts(_pairs(spark, folder)).join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    kinds = ("consistent", "condition_mismatch", "document_variant_conflict")
    return out.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])


def verdict_tolerance_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """How verdicts change with the tolerance, and how many agree with the standard one."""
    table_ = spark.createDataFrame([(t,) for t in TOLERANCES], "tolerance double")
    each = _verdicts(_pairs(spark, folder)).withColumnRenamed("verdict", "standard").join(F.broadcast(table_))
    out = _verdicts(each, F.col("tolerance"))
    return out.groupBy("tolerance").agg(F.count_if(F.col("verdict") == "consistent").alias("consistent"), F.count_if(F.col("verdict") == "condition_mismatch").alias("condition_mismatch"), F.count_if(F.col("verdict") == F.col("standard")).alias("agree"))


def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Properties (ship modes of a flag) that only one of two sources states."""
    l = table(spark, folder, "lineitem")
    side = lambda f: l.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey").distinct().withColumn(f, F.lit(1))
    both = side("A").join(side("R"), ["l_partkey", "l_suppkey"], "full_outer")
    kind = F.when(F.col("R").isNull(), "a_only").when(F.col("A").isNull(), "b_only").otherwise("both")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, folder, "lineitem").select("l_partkey", "l_returnflag", F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    w = Window.partitionBy("l_partkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "value", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = l.withColumn("pos", F.row_number().over(w))
    return rows.where("l_returnflag = 'A'").select("l_partkey", "pos", "value"), rows.where("l_returnflag = 'R'").select("l_partkey", "pos", "value")


def greedy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Globally greedy pairing of two documents' values per part, with the leftovers."""
    return matching.greedy_pairs(*_sides(spark, folder), ["l_partkey"], "value")


def match_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Gold claims in order, each with its first unused close prediction."""
    return matching.gold_order(*_sides(spark, folder), ["l_partkey"])


def evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """True and false positives of the matches, with precision, recall and F1 over all parts."""
    gold, predicted = _sides(spark, folder)
    m = matching.gold_order(gold, predicted, ["l_partkey"]).agg(F.count("p").alias("tp"), F.count("g").alias("gold"))
    both = m.join(F.broadcast(predicted.agg(F.count(F.lit(1)).alias("predicted")))).select("tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"))
    return rounded(both.select("tp", "fp", "fn", *stats.scores(F.col("tp"), F.col("fp"), F.col("fn"))))


def consensus_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Values of a user that at least two event types (runs) share within 2 %."""
    e = table(spark, folder, "events")
    run = F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type"))
    pos = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts"))
    return rounded(matching.consensus(e.select("user_id", run.alias("run"), pos.alias("pos"), "value"), ["user_id"]))


def merged_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Frozen claims and those of another run that match none of them within 2 %."""
    a, b = _sides(spark, folder)
    x, y = a.alias("x"), b.alias("y")
    extra = y.join(x, (F.col("x.l_partkey") == F.col("y.l_partkey")) & close(F.col("x.value"), F.col("y.value")), "left_anti")
    return store.counts_by(spark, {"frozen": x, "added": extra, "merged": x.unionByName(extra)})


def promotion_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What a person decides on: counts, distinct values and extremes of each status."""
    o = table(spark, folder, "orders")
    out = o.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"), F.min("o_totalprice").alias("least"),
        F.max("o_totalprice").alias("most"), F.count_if(F.col("o_totalprice") > 200000).alias("flagged"),
    )
    return rounded(out)


QUERIES = {f.__name__: f for f in (
    graph_counts, relationship_counts, path_counts, measurement_paths, claims_by_source, predicate_lookup, point_lookup, problem_order, claim_ids, instance_measurements,
    upsert_sources, load_idempotent, part_rebuilt, unique_keys, set_compare, gold_diff, measured_distribution, claim_vs_measured, nearest_condition_claim, spec_verdicts,
    spec_summary, verdict_tolerance_sweep, coverage_gaps, greedy_pairs, match_claims, evaluation, consensus_clusters, merged_predictions, promotion_summary,
)}

_PRICES = "pr AS (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem)"
_TEXT_SQL = "[" + ", ".join(f"'{t}'" for t in _TEXTS) + "]"


def _close_sql(a: str, b: str, t: str) -> str:
    return f"abs({a} - {b}) <= {t} * greatest(abs({a}), abs({b}), 1e-9)"


_PAIRS = f"""one AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS v, max(l_linenumber)::DOUBLE AS c, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
    sd AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS r, ({_TEXT_SQL})[l_suppkey % 4 + 1] AS t FROM one),
    pairs AS (SELECT a.l_partkey, a.v AS va, b.v AS vb, a.c AS ca, b.c AS cb, a.n AS na, b.n AS nb,
        CASE a.t WHEN 'Max. value' THEN 'upper' WHEN 'min. 5 A' THEN 'lower' WHEN 'over 3' THEN 'lower' END AS ua, CASE b.t WHEN 'Max. value' THEN 'upper' WHEN 'min. 5 A' THEN 'lower' WHEN 'over 3' THEN 'lower' END AS ub
        FROM sd a JOIN sd b ON a.l_partkey = b.l_partkey AND a.r = 1 AND b.r = 2)"""


def _verdict_sql(t: str) -> str:
    meets = lambda x, u, y: f"(({u} = 'upper' AND {y} <= {x} * (1 + {t})) OR ({u} = 'lower' AND {y} >= {x} * (1 - {t})))"
    return f"""CASE WHEN {_close_sql("va", "vb", t)} THEN CASE WHEN NOT ({_close_sql("ca", "cb", t)}) OR NOT ({_close_sql("na", "nb", t)}) THEN 'condition_mismatch' ELSE 'consistent' END
        WHEN ua IS DISTINCT FROM ub AND (coalesce({meets("va", "ua", "vb")}, false) OR coalesce({meets("vb", "ub", "va")}, false)) THEN 'consistent' ELSE 'document_variant_conflict' END"""


ORACLE = {
    "graph_counts": " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM {n}" for n in LABELS),
    "relationship_counts": """SELECT n_name, count(c_custkey) AS customers, round(min(c_acctbal), 6) AS least_balance, round(quantile_cont(c_acctbal, 0.5), 6) AS median_balance
        FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name""",
    "path_counts": """SELECT r_name, count(DISTINCT c_custkey) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name""",
    "measurement_paths": """SELECT c_mktsegment, count(*) AS n, round(sum(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "claims_by_source": "SELECT n_name, s_suppkey, s_name, round(s_acctbal, 6) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1",
    "predicate_lookup": "SELECT p_brand, count(*) AS n FROM part WHERE contains(p_name, 'gear') AND p_type IS NOT NULL GROUP BY 1",
    "point_lookup": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42",
    "problem_order": "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS price FROM orders ORDER BY (o_orderstatus <> 'O')::INT, o_totalprice DESC, o_orderkey LIMIT 10",
    "claim_ids": """WITH i AS (SELECT l_suppkey AS source, concat_ws(':', l_suppkey::VARCHAR, l_returnflag,
            (row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) - 1)::VARCHAR) AS id FROM lineitem)
        SELECT source, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first_id, max(id) AS last_id FROM i GROUP BY source""",
    "instance_measurements": """WITH m AS (SELECT o_orderkey, 'price' AS metric, 'eur' AS unit, o_orderstatus <> 'F' AS censored, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS value FROM orders
        UNION ALL SELECT o_orderkey, 'year', 'a', false, year(o_orderdate)::DOUBLE FROM orders
        UNION ALL SELECT o_orderkey, 'urgent', 'n', NOT starts_with(o_orderpriority, '1'), CASE WHEN starts_with(o_orderpriority, '1') THEN length(o_orderpriority)::DOUBLE END FROM orders)
        SELECT metric, unit, censored, count(*) AS n, round(sum(value), 6) AS total, count(DISTINCT o_orderkey) AS ids FROM m GROUP BY 1, 2, 3""",
    "upsert_sources": """WITH n AS (SELECT c_custkey + 1 AS k, CASE WHEN c_custkey % 2 = 0 THEN 1.5::DOUBLE END AS b FROM customer WHERE c_mktsegment LIKE '%A%')
        SELECT coalesce(k, c_custkey) AS c_custkey, coalesce(b, round(c_acctbal, 6)) AS c_acctbal, coalesce(c_mktsegment, 'NEW') AS c_mktsegment FROM customer FULL JOIN n ON k = c_custkey""",
    "load_idempotent": """WITH n AS (SELECT c_custkey + 2 AS k FROM customer WHERE round(c_acctbal, 6) < 0),
        u AS (SELECT CASE WHEN k IS NOT NULL THEN 'X' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN k IS NOT NULL THEN 2.5 ELSE round(c_acctbal, 6) END AS b FROM customer FULL JOIN n ON k = c_custkey)
        SELECT c_mktsegment, count(*) AS n, round(sum(b), 4) AS balance FROM u GROUP BY 1""",
    "part_rebuilt": """WITH e AS (SELECT DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS view, l_suppkey AS src, l_partkey AS dst FROM lineitem),
        n AS (SELECT DISTINCT 'condition' AS view, src, dst + 1 AS dst FROM e WHERE src % 10 = 0),
        o AS (SELECT * FROM e WHERE NOT (coalesce(view, 'condition') = 'condition' AND src % 10 = 0) UNION ALL SELECT * FROM n)
        SELECT coalesce(view, 'none') AS view, count(*) AS n, sum(dst)::BIGINT AS total FROM o GROUP BY 1""",
    "unique_keys": " UNION ALL ".join(
        f"SELECT '{t}' AS label, count(*) AS n FROM (SELECT 1 FROM {t} GROUP BY {k} HAVING count(*) > 1)"
        for t, k in (("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey, l_linenumber"))
    ),
    "set_compare": """WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 1), c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0 AND c_nationkey < 20)
        SELECT 'both' AS label, count(*) AS n FROM (SELECT k FROM n INTERSECT SELECT k FROM c) UNION ALL SELECT 'first_only', count(*) FROM (SELECT k FROM n EXCEPT SELECT k FROM c)
        UNION ALL SELECT 'second_only', count(*) FROM (SELECT k FROM c EXCEPT SELECT k FROM n)""",
    "gold_diff": """WITH a AS (SELECT p_partkey AS k, p_brand AS b, round(p_retailprice, 2) AS v, p_size AS s FROM part WHERE p_size <> 3),
        c AS (SELECT CASE WHEN p_size = 5 THEN -p_partkey ELSE p_partkey END AS k, p_brand AS b, round(p_retailprice, 2) AS v, CASE WHEN p_size = 6 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_size <> 4),
        j AS (SELECT a.k AS k1, c.k AS k2, a.b AS b1, c.b AS b2, a.v AS v1, c.v AS v2, a.s AS s1, c.s AS s2 FROM a FULL JOIN c ON a.k = c.k)
        SELECT 'added' AS label, count(*) AS n FROM j WHERE k1 IS NULL UNION ALL SELECT 'removed', count(*) FROM j WHERE k2 IS NULL
        UNION ALL SELECT 'renamed', count(*) FROM j x JOIN j y ON x.k2 IS NULL AND y.k1 IS NULL AND abs(x.k1) = abs(y.k2) AND x.b1 = y.b2 AND x.v1 = y.v2 AND x.s1 = y.s2
        UNION ALL SELECT 'conditions_changed', count(*) FROM j WHERE k1 IS NOT NULL AND k2 IS NOT NULL AND s1 <> s2""",
    "measured_distribution": f"""WITH {_PRICES} SELECT p_brand, count(price) AS n, round(quantile_cont(price, 0.5), 6) AS median, round(min(price), 6) AS least, round(max(price), 6) AS most,
        round(quantile_cont(price, 0.25), 6) AS q1, round(quantile_cont(price, 0.75), 6) AS q3 FROM pr JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "claim_vs_measured": f"""WITH {_PRICES} SELECT p_partkey, count(price) AS n, round(quantile_cont(price, 0.5), 8) AS median, round(quantile_cont(price, 0.25), 8) AS q1, round(quantile_cont(price, 0.75), 8) AS q3,
        round((quantile_cont(price, 0.5) - any_value(p_retailprice)) / nullif(abs(any_value(p_retailprice)), 0), 8) AS gap FROM pr JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "nearest_condition_claim": f"""WITH {_PRICES}, c AS (SELECT *, CASE WHEN p_partkey % 11 <> 0 THEN p_size::DOUBLE END AS claim_at FROM part), m AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS measured_at FROM pr),
        x AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN claim_at IS NULL THEN coalesce(measured_at, 1e9) ELSE abs(coalesce(measured_at, 1e9) - claim_at) END,
            l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_discount, l_tax) AS r FROM c JOIN m ON p_partkey = l_partkey)
        SELECT p_partkey AS id, claim_at, measured_at, coalesce(abs(claim_at - measured_at) <= 0.2 * greatest(abs(claim_at), abs(measured_at)), false) AS comparable, round((price - p_retailprice) / p_retailprice, 6) AS gap FROM x WHERE r = 1""",
    "spec_verdicts": f"""WITH {_PAIRS} SELECT l_partkey, {_verdict_sql("0.02")} AS verdict,
        concat_ws(',', CASE WHEN NOT ({_close_sql("ca", "cb", "0.02")}) THEN 'current' END, CASE WHEN NOT ({_close_sql("na", "nb", "0.02")}) THEN 'n' END) AS differing FROM pairs""",
    "spec_summary": f"""WITH {_PAIRS}, v AS (SELECT p_brand, {_verdict_sql("0.02")} AS verdict FROM pairs JOIN part ON p_partkey = l_partkey)
        SELECT p_brand, count(*) AS n, count(*) FILTER (verdict = 'consistent') AS consistent, count(*) FILTER (verdict = 'condition_mismatch') AS condition_mismatch,
               count(*) FILTER (verdict = 'document_variant_conflict') AS document_variant_conflict FROM v GROUP BY 1""",
    "verdict_tolerance_sweep": f"""WITH {_PAIRS}, ts AS (SELECT * FROM (VALUES {", ".join(f"({t}::DOUBLE)" for t in TOLERANCES)}) x(tolerance)),
        v AS (SELECT tolerance, {_verdict_sql("tolerance")} AS verdict, {_verdict_sql("0.02::DOUBLE")} AS standard FROM pairs, ts)
        SELECT tolerance, count(*) FILTER (verdict = 'consistent') AS consistent, count(*) FILTER (verdict = 'condition_mismatch') AS condition_mismatch, count(*) FILTER (verdict = standard) AS agree FROM v GROUP BY 1""",
    "coverage_gaps": """WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
        SELECT CASE WHEN r.l_partkey IS NULL THEN 'a_only' WHEN a.l_partkey IS NULL THEN 'b_only' ELSE 'both' END AS kind, count(*) AS n FROM a FULL JOIN r ON a.l_partkey = r.l_partkey AND a.l_suppkey = r.l_suppkey GROUP BY 1""",
    "merged_predictions": """WITH x AS (SELECT l_partkey, l_quantity AS v FROM lineitem WHERE l_returnflag = 'A'), y AS (SELECT l_partkey, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R'),
        e AS (SELECT count(*) AS n FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.l_partkey = y.l_partkey AND abs(x.v - y.v) <= 0.02 * greatest(abs(x.v), abs(y.v), 1e-9)))
        SELECT 'frozen' AS label, count(*) AS n FROM x UNION ALL SELECT 'added', n FROM e UNION ALL SELECT 'merged', count(*) + any_value(e.n) FROM x, e""",
    "promotion_summary": """SELECT o_orderstatus, count(*) AS n, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, round(min(o_totalprice), 6) AS least, round(max(o_totalprice), 6) AS most,
        count(*) FILTER (o_totalprice > 200000) AS flagged FROM orders GROUP BY 1""",
}
