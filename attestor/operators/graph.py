"""Similarity graphs: exact nearest neighbours in cells, coverage, neighbour statistics.

Edges are (view, src, dst, weight, same_group) with weight = 1 / (1 + distance); rankings break ties by dst.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.storage import stored

#: Queries, or vectors of a short bank, in a block: blocks are one task's work, so memory stays bounded and only top rows leave it.
BLOCK = 10_000
#: Vectors that a cell of a long bank is meant to hold, levels of the tree of cells, rows that its cuts are fitted on, rows that bound distances.
CELL, MOST_LEVELS, SAMPLE, SAMPLE_BOUND = 2_000, 12, 20_000, 2_000
#: Queries whose products with a block are in memory at once.
AT_ONCE = 256


def scaling(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean and population deviation of each column."""
    return rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])


def zscored(rows: DataFrame, columns: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """``rows`` with each column less its mean and divided by its deviation (1 where that is 0), their own unless ``stats`` is given."""
    stats = scaling(rows, columns) if stats is None else stats
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in columns}
    return rows.join(F.broadcast(stats)).withColumns(z).select(rows.columns)


def features(rows: DataFrame, id_col: str, group_col: str, columns: dict[str, Column], scale: bool = True) -> DataFrame:
    """(id, grp, vec): rows whose features are all given, z-scored and packed into an array."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), *[c.cast("double").alias(n) for n, c in columns.items()]).dropna(subset=list(columns))
    if scale:
        picked = zscored(picked, list(columns))
    return picked.select("id", "grp", F.array(*columns).alias("vec"))


def nearest(queries: DataFrame, bank: DataFrame, k: int, exclude_self: bool = True, exclude_group: bool = False, size: int | None = None, within: str | None = None) -> DataFrame:
    """(src, dst, weight, same_group): the k bank rows nearest to each query row, among those of equal ``within`` if given.

    Exact.  Up to ``BLOCK`` bank rows are one block.  More are dealt into cells of space, by the cuts of a tree that is fitted on a
    bounded sample.  A query's own cell, or a sample, bounds the distance of its k-th neighbour, and only cells whose box
    comes within that bound are searched, so the work grows far slower than queries times bank while few dimensions are used.  What a
    cell finds by a matrix product is measured again without its rounding, and only the k best for each query leave it.  Rows
    are excluded by id or group, never by distance.
    """
    n, extra = size or bank.count(), [within] if within else []
    named = [F.col(c).alias(n) for c, n in [*((c, f"{c}_") for c in ("id", "grp", "vec")), *((c, c) for c in extra)]]  # new columns, as both sides may come from one table
    left, right = queries.select(*named), bank.select(*named)
    if n <= BLOCK:
        left, right = (d.withColumn("cell", F.lit(0)) for d in (left.withColumn("bound", F.lit(float("inf"))), right))
        return top_edges(_searched(left, right, k, exclude_self, exclude_group, within), k, within)
    # of copies in one group only the first ones by id can be among the k nearest, or k + 1 with the query itself
    copies = Window.partitionBy(*extra, "vec_", "grp_").orderBy("id_")
    right = right.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    right = stored(right, "bank")
    cell = _cells(right, within)
    right = stored(right.withColumn("cell", cell("vec_")), "cells")
    dims = len(right.select("vec_").first()[0])
    ends = [f(F.get("vec_", F.lit(i))) for i in range(dims) for f in (F.min, F.max)]
    boxes = {}
    for r in right.groupBy(*extra, "cell").agg(F.array(*ends).alias("ends")).collect():
        boxes.setdefault(r[within] if within else None, []).append((r["cell"], r["ends"]))
    boxes = {w: (np.array([c for c, _ in own]), np.array([e for _, e in own], float).reshape(len(own), dims, 2)) for w, own in boxes.items()}
    few = right.withColumn("at", F.row_number().over(Window.partitionBy(*extra).orderBy(F.xxhash64("id_"), "id_"))).where(F.col("at") <= SAMPLE_BOUND)
    sample = {None: few.drop("at").toPandas()} if not within else dict(iter(few.drop("at").toPandas().groupby(within)))

    def bounded(key: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        w = key[0] if within else None
        out, (names, box) = [], boxes.get(w, (np.zeros(0, int), np.zeros((0, dims, 2))))
        for part, square, room in _products(q, b, exclude_self, exclude_group):
            bound = _kth(square, k) + room
            if w in sample and (open_ := np.flatnonzero(np.isinf(bound))).size:
                for rest, square, room in _products(part.iloc[open_], sample[w], exclude_self, exclude_group):
                    bound[open_[: len(rest)]], open_ = _kth(square, k) + room, open_[len(rest) :]
            v, away = np.stack(part["vec_"]).astype(float), np.zeros((len(part), len(names)))
            for i in range(dims):
                away += np.maximum(np.maximum(box[None, :, i, 0] - v[:, i, None], v[:, i, None] - box[None, :, i, 1]), 0) ** 2
            met = away <= bound[:, None]
            out.append(part[[*extra, "id_", "grp_", "vec_"]].assign(bound=bound, met=[names[m] for m in met]))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*extra, "id_", "grp_", "vec_", "bound", "met"]}, dtype=object)

    kinds = dict(left.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*extra, "id_", "grp_", "vec_"]) + ", bound double, met array<int>"
    bounds = stored(_dealt(left.withColumn("cell", cell("vec_")), right, within).applyInPandas(bounded, schema), "bounds")
    visits = bounds.select(*extra, "id_", "grp_", "vec_", "bound", F.explode("met").alias("cell"))
    return top_edges(_searched(visits, right, k, exclude_self, exclude_group, within), k, within)


def _cells(bank: DataFrame, within: str | None):
    """A function from vectors to the number of their cell, by a complete tree of cuts at medians of a sample of at most ``SAMPLE`` or so rows."""
    per = [r["count"] for r in bank.groupBy(*([within] if within else [])).count().collect()]
    depth = min(MOST_LEVELS, max(1, math.ceil(math.log2(max(per) / CELL))))
    rare = max(1, math.ceil(sum(per) / SAMPLE))
    x = np.stack(bank.where(F.pmod(F.xxhash64("id_", *([within] if within else [])), F.lit(rare)) == 0).select("vec_").toPandas()["vec_"].tolist() or [bank.select("vec_").first()[0]]).astype(float)
    axis, cut = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
    own = {0: x}
    for node in range(2**depth - 1):
        rows = own.pop(node)
        if len(rows):
            axis[node] = int(np.argmax(rows.std(axis=0)))
            cut[node] = np.median(rows[:, axis[node]])
        right = rows[:, axis[node]] > cut[node]
        own[2 * node + 1], own[2 * node + 2] = rows[~right], rows[right]

    @F.pandas_udf("int")
    def cell(vec: pd.Series) -> pd.Series:
        v, node, row = np.stack(vec).astype(float), np.zeros(len(vec), int), np.arange(len(vec))
        for _ in range(depth):
            node = 2 * node + 1 + (v[row, axis[node]] > cut[node])
        return pd.Series(node - (2**depth - 1))

    return cell


def _dealt(visits: DataFrame, bank: DataFrame, within: str | None):
    """Visits and bank rows by cell; the visits of a cell are sliced into about ``BLOCK`` rows, each with the cell's bank rows."""
    keys = [*([within] if within else []), "cell"]
    slices = F.broadcast(visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("slices")))
    left = visits.join(slices, keys).withColumn("slice", F.pmod(F.xxhash64("id_"), F.col("slices")).cast("int")).drop("slices")
    right = bank.join(slices, keys).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    # a given number of partitions: few bytes are much work here, so small partitions are not to be joined
    parts, names = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "slice"]
    left, right = (d.repartition(parts, *names) for d in (left, right))
    return left.groupBy(*names).cogroup(right.groupBy(*names))


def _products(q: pd.DataFrame, b: pd.DataFrame, exclude_self: bool, exclude_group: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(queries, squared distances to all of ``b``, room for their rounding) for ``AT_ONCE`` queries at a time; infinite where excluded."""
    ids, groups = b["id_"].to_numpy(), b["grp_"].to_numpy()
    x = np.stack(b["vec_"]).astype(float) if len(b) else None
    norm = (x * x).sum(axis=1) if len(b) else np.zeros(0)
    for at in range(0, len(q), AT_ONCE):
        part = q.iloc[at : at + AT_ONCE]
        v = np.stack(part["vec_"]).astype(float)
        own = (v * v).sum(axis=1)
        square = own[:, None] + norm[None, :] - 2 * (v @ x.T) if len(b) else np.zeros((len(part), 0))
        if exclude_self:
            square[ids[None, :] == part["id_"].to_numpy()[:, None]] = np.inf
        if exclude_group:
            square[groups[None, :] == part["grp_"].to_numpy()[:, None]] = np.inf
        square[np.isnan(square)] = np.inf
        yield part, square, 1e-9 * (own + norm.max(initial=0) + 1)


def _candidates(q: pd.DataFrame, b: pd.DataFrame, x: np.ndarray, k: int, exclude_self: bool, exclude_group: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(queries, i, j): the rows of ``b`` (vectors ``x``) that can be among the k nearest, for ``AT_ONCE`` queries at a time.

    Where a query's bound is known, one product and one comparison tell; no order of all distances is needed.
    """
    known = np.isfinite(q["bound"].to_numpy())
    ids, groups, norm = b["id_"].to_numpy(), b["grp_"].to_numpy(), (x * x).sum(axis=1)
    wide = np.concatenate([2 * x, -norm[:, None]], axis=1).T
    bounded = q[known]
    for at in range(0, len(bounded), AT_ONCE):
        part = bounded.iloc[at : at + AT_ONCE]
        v = np.stack(part["vec_"]).astype(float)
        own = (v * v).sum(axis=1)
        least = own - part["bound"].to_numpy() - 1e-9 * (own + norm.max(initial=0) + 1)
        i, j = np.nonzero(np.concatenate([v, np.ones((len(v), 1))], axis=1) @ wide >= least[:, None])
        kept = np.ones(len(i), bool)
        if exclude_self:
            kept &= ids[j] != part["id_"].to_numpy()[i]
        if exclude_group:
            kept &= groups[j] != part["grp_"].to_numpy()[i]
        yield part, i[kept], j[kept]
    for part, square, room in _products(q[~known], b, exclude_self, exclude_group):
        yield part, *np.nonzero((square <= (_kth(square, k) + room)[:, None]) & (square < np.inf))


def _kth(square: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest of each row, infinite with fewer."""
    return np.partition(square, k - 1, axis=1)[:, k - 1] if square.shape[1] >= k else np.full(len(square), np.inf)


def _searched(visits: DataFrame, bank: DataFrame, k: int, exclude_self: bool, exclude_group: bool, within: str | None) -> DataFrame:
    """The k best edges of every visit (a query, its bound and a cell) that are no farther than the bound."""

    def best(key: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(b):
            b = b.sort_values("id_")
            ids, groups, x = b["id_"].to_numpy(), b["grp_"].to_numpy(), np.stack(b["vec_"]).astype(float)
            for part, i, j in _candidates(q, b, x, k, exclude_self, exclude_group):
                src, group, v = part["id_"].to_numpy(), part["grp_"].to_numpy(), np.stack(part["vec_"]).astype(float)
                weight = 1 / (1 + np.sqrt(((x[j] - v[i]) ** 2).sum(axis=1)))
                order = np.lexsort((j, -weight, i))
                i, j, weight = i[order], j[order], weight[order]
                top = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
                i, j, weight = i[top], j[top], weight[top]
                parts.append(pd.DataFrame({"src": src[i], "dst": ids[j], "weight": weight, "same_group": groups[j] == group[i]}))
        out = pd.concat(parts) if parts else pd.DataFrame({"src": [], "dst": [], "weight": [], "same_group": []})
        return out.assign(**({within: key[0]} if within else {}))

    schema = "src long, dst long, weight double, same_group boolean" + (f", {within} {dict(visits.dtypes)[within]}" if within else "")
    return _dealt(visits, bank, within).applyInPandas(best, schema)


def top_edges(edges: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """The k heaviest edges of each source (``within`` each value of a column), ties by dst."""
    w = Window.partitionBy(*([within] if within else []), "src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def similarity_edges(vectors: DataFrame, view: str, k: int = 10) -> DataFrame:
    """The graph of one view: ranked by the full weight, stored with six decimals."""
    edges = nearest(vectors, vectors, k)
    return edges.select(F.lit(view).alias("view"), "src", "dst", F.round("weight", 6).alias("weight"), "same_group")


def ranked_sum(edges: DataFrame, k: int, where: Column | None = None, out: str = "coverage") -> DataFrame:
    """(src, out): the sum of the k largest weights, of edges for which ``where`` holds."""
    edges = edges if where is None else edges.where(where)
    return top_edges(edges, k).groupBy("src").agg(F.sum("weight").alias(out))


def coverage(ids: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(id, coverage_all, coverage_xgroup) of every id; 0 without edges.  The second leaves out the own group."""
    both = ranked_sum(edges, k, None, "coverage_all").join(ranked_sum(edges, k, ~F.col("same_group"), "coverage_xgroup"), "src", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return ids.join(both.withColumnRenamed("src", "id"), "id", "left").select("id", zero("coverage_all"), zero("coverage_xgroup"))


def grouped(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``edges`` (src, dst, weight) with the groups of both ends."""
    known = edges.select("src", "dst", "weight").join(groups.select(F.col("id").alias("dst"), F.col("grp").alias("dst_grp")), "dst")
    return known.join(groups.select(F.col("id").alias("src"), F.col("grp").alias("src_grp")), "src").select("src", "dst", "weight", "src_grp", "dst_grp")


def without_each(edges: DataFrame, k: int) -> DataFrame:
    """(fold, src, dst, weight, src_grp): for each source and each group among its edges, the k best edges into the others.

    Only these folds change a source's k best edges; a source meets its own few edges, not all folds.
    """
    touched = edges.select("src", F.col("dst_grp").alias("fold")).distinct()
    w = Window.partitionBy("fold", "src").orderBy(F.desc("weight"), "dst")
    left = edges.join(touched, "src").where("dst_grp <> fold").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return left.select("fold", "src", "dst", "weight", "src_grp")


def fold_edges(edges: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """(fold, src, dst, weight, is_test): with each group held out in turn, the k stored edges into the other groups.

    ``groups`` has (id, grp).  A source that is itself held out is a test row of that fold.
    """
    folds = groups.agg(F.array_sort(F.collect_set("grp")).alias("folds"))
    known = grouped(edges, groups)
    touched = known.groupBy("src").agg(F.collect_set("dst_grp").alias("touched"))
    best = top_edges(known, k).join(touched, "src").join(F.broadcast(folds))
    same = best.select(F.explode(F.array_except("folds", "touched")).alias("fold"), "src", "dst", "weight", "src_grp")
    return same.unionByName(without_each(known, k)).select("fold", "src", "dst", "weight", (F.col("src_grp") == F.col("fold")).alias("is_test"), "src_grp")


def held_out_edges(edges: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """(fold, src, dst, weight): the test rows of ``fold_edges`` alone, each source in the fold of its own group."""
    known = grouped(edges, groups).where("src_grp <> dst_grp")
    return top_edges(known, k).select(F.col("src_grp").alias("fold"), "src", "dst", "weight")


def neighbour_statistics(edges: DataFrame, targets: DataFrame, keys: Sequence[str] = ("src",)) -> DataFrame:
    """Weighted mean and deviation of the neighbours' y, mean and sum of weights; ``targets`` has (id, y)."""
    known = edges.join(targets.select(F.col("id").alias("dst"), "y"), "dst")
    mean = known.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("nbr_mean"))
    centred = known.join(mean, list(keys)).withColumn("square", F.col("weight") * (F.col("y") - F.col("nbr_mean")) ** 2)
    return centred.groupBy(*keys).agg(
        F.first("nbr_mean").alias("nbr_mean"), F.sqrt(F.sum("square") / F.sum("weight")).alias("nbr_std"),
        F.avg("weight").alias("mean_weight"), F.sum("weight").alias("coverage"),
    )


def query_features(queries: DataFrame, bank: DataFrame, columns: Sequence[str], k: int = 5, exclude_group: bool = False) -> DataFrame:
    """(id, nbr_mean, nbr_std, mean_weight, coverage) of every query over its k nearest rows of the bank.

    Both have (id, grp, columns), the bank also y.  Queries are scaled by the bank's means and deviations, so a query gets
    the same features whatever comes with it; one that is in the bank itself is never its own neighbour.  Queries without
    neighbours have no statistics and coverage 0.
    """
    stats = scaling(bank, columns)
    packed = lambda rows: zscored(rows.select("id", "grp", *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=list(columns)), columns, stats).select("id", "grp", F.array(*columns).alias("vec"))
    found = nearest(packed(queries), packed(bank), k, exclude_group=exclude_group)
    known = neighbour_statistics(found, bank.select("id", "y")).withColumnRenamed("src", "id")
    return queries.select("id").join(known, "id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def loo_coverage(edges: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """(id, coverage): of each bank row over the rest of the bank, its own group left out."""
    inside = edges.join(groups.select(F.col("id").alias("dst"), F.col("grp").alias("dst_grp")), "dst").join(groups.select(F.col("id").alias("src"), "grp"), "src")
    sums = ranked_sum(inside.where("grp <> dst_grp"), k)
    return groups.join(sums.withColumnRenamed("src", "id"), "id", "left").select("id", "grp", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
