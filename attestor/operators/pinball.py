"""Boosted trees of conditional quantiles, grown from histograms that Spark sums over partitions.

Many models are grown at once: rows carry the key of their model (a fold), and every quantile has its own trees.  Columns are
binned once at quantiles of their values.  For each level of a round, tasks count for their rows, by model, quantile, node,
column and bin, how many there are and how many lie below the present prediction; these counts are exact gradients of the
pinball loss, so no sum depends on the order of rows.  Spark adds them up, takes running sums over bins and the best split of each
node; only the chosen splits reach the driver.  A leaf's value is the quantile of the residuals of its rows, as squared gradients say
nothing about the size of a step.  Rows with their predictions are stored once a round.

Defined results: missing values and NaN lie below all others; ties go to the first column and then the lowest bin; a node that
no split improves stays a leaf; a model without training rows predicts null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.storage import stored

# Fixed values of the models: rounds, depth, rate, bins, weight that damps small leaves.
ROUNDS, DEPTH, RATE, BINS, DAMPING = 10, 3, 0.1, 32, 1.0
#: Accuracy of the quantiles of residuals: exact up to so many rows of a leaf.
ACCURACY = 100_000
STATE = "model int, id long, train boolean, y double, bins binary, margins array<double>, leaves array<int>"
COUNTS = "model int, a int, node int, feature int, bin int, n long, below long"


class Trees:
    """The trees of all models so far: for each (model, quantile) a list of (splits, values) by node, the root being 1."""

    def __init__(self, rate: float):
        self.rate = rate
        self.base: dict[int, list[float]] = {}
        self.splits: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        self.values: dict[tuple[int, int], dict[int, float]] = {}

    def nodes(self, model: int, a: int, bins: np.ndarray) -> np.ndarray:
        """The node of the growing tree that each row has reached."""
        at, own = np.ones(len(bins), np.int64), self.splits.get((model, a), {})
        for node in sorted(own):  # parents come first
            feature, cut = own[node]
            here = at == node
            at[here] = 2 * node + (bins[here, feature] > cut)
        return at


def edges(rows: DataFrame, x: str, features: int, bins: int = BINS) -> list[list[float]]:
    """For each column the ascending cuts between its bins: quantiles of the training rows, without repeats."""
    shares = [i / bins for i in range(1, bins)]
    known = [F.when(~F.isnan(F.get(x, F.lit(j))), F.get(x, F.lit(j))) for j in range(features)]
    found = rows.where("train").agg(*[F.percentile_approx(c, shares, ACCURACY).alias(f"c{j}") for j, c in enumerate(known)]).first()
    return [sorted(set(cuts or [])) for cuts in found]


def binned(rows: DataFrame, x: str, cuts: list[list[float]]) -> DataFrame:
    """(model, id, train, y, bins): a byte for each column, 0 if missing, else 1 and the number of cuts below the value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = np.array([[np.nan if v is None else v for v in row] for row in b[x]], float).reshape(len(b), len(cuts))
            out = np.zeros(values.shape, np.uint8)
            for j, c in enumerate(cuts):
                known = ~np.isnan(values[:, j])
                out[known, j] = 1 + np.searchsorted(np.array(c), values[known, j], side="left")
            yield pd.DataFrame({"model": b["model"], "id": b["id"], "train": b["train"], "y": b["y"], "bins": [r.tobytes() for r in out]})

    picked = rows.select(F.col("model").cast("int").alias("model"), F.col("id").cast("long").alias("id"), "train", F.col("y").cast("double").alias("y"), x)
    return picked.mapInPandas(run, "model int, id long, train boolean, y double, bins binary")


def _matrix(b: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), -1)


def _margins(b: pd.DataFrame, trees: Trees) -> np.ndarray:
    """Predictions of the rows of one model: the stored ones and the step of the last stored leaves."""
    out = np.array(b["margins"].tolist(), float)
    model = int(b["model"].iloc[0])
    for a in range(out.shape[1]):
        values = trees.values.get((model, a))
        if values:
            out[:, a] += trees.rate * np.array([values.get(int(n), 0.0) for n in (row[a] for row in b["leaves"])])
    return out


def _counted(state: DataFrame, trees: Trees, alphas: int, level: int) -> DataFrame:
    """``COUNTS`` of the training rows in the nodes of one level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for model, b in batch.groupby("model"):
                x, margins, y = _matrix(b), _margins(b, trees), b["y"].to_numpy()
                for a in range(alphas):
                    at = trees.nodes(model, a, x)
                    used = at >= 1 << level
                    cell = (((at[used] - (1 << level))[:, None] * x.shape[1] + np.arange(x.shape[1])) * 256 + x[used]).ravel()
                    size = (1 << level) * x.shape[1] * 256
                    below = np.repeat(y[used] < margins[used, a], x.shape[1])
                    both = np.stack([np.bincount(cell, minlength=size), np.bincount(cell[below], minlength=size)])
                    totals[model, a] = totals[model, a] + both if (model, a) in totals else both
        for (model, a), (n, below) in totals.items():
            cell = np.flatnonzero(n)
            features = len(n) // 256 >> level
            node, rest = np.divmod(cell, features * 256)
            yield pd.DataFrame({"model": model, "a": a, "node": node + (1 << level), "feature": rest // 256, "bin": rest % 256, "n": n[cell], "below": below[cell]})

    counts = state.where("train").mapInPandas(run, COUNTS)
    return counts.groupBy("model", "a", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))


def best_splits(counts: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """(model, a, node, feature, bin): of each node the split with the largest gain, if that is positive."""
    up = Window.partitionBy("model", "a", "node", "feature").orderBy("bin")
    whole = Window.partitionBy("model", "a", "node", "feature")
    each = counts.select("*", *[F.sum(c).over(up).alias(f"left_{c}") for c in ("n", "below")], *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("n", "below")])
    alpha = F.element_at(F.array(*map(F.lit, alphas)), F.col("a") + 1)
    score = lambda n, below: F.pow(below - alpha * n, F.lit(2.0)) / (n + DAMPING)
    n, below = F.col("all_n") - F.col("left_n"), F.col("all_below") - F.col("left_below")
    gain = F.round(score(F.col("left_n"), F.col("left_below")) + score(n, below) - score(F.col("all_n"), F.col("all_below")), 9)
    order = F.struct(F.col("gain"), -F.col("feature"), -F.col("bin"))
    best = each.where("left_n < all_n").withColumn("gain", gain).where("gain > 0").groupBy("model", "a", "node").agg(F.max_by(F.struct("feature", "bin"), order).alias("s"))
    return best.select("model", "a", "node", "s.feature", "s.bin")


def _grown(state: DataFrame, trees: Trees, alphas: int) -> DataFrame:
    """``STATE`` with the step of the last trees taken and the leaves of the present ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, b in batch.groupby("model"):
                x = _matrix(b)
                leaves = np.stack([trees.nodes(model, a, x) for a in range(alphas)], axis=1)
                yield b.assign(margins=list(_margins(b, trees)), leaves=list(leaves.astype(np.int32)))[[c.split()[0] for c in STATE.split(", ")]]

    return state.mapInPandas(run, STATE)


def fit_predict(rows: DataFrame, x: str, features: int, alphas: Sequence[float], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> DataFrame:
    """(model, id, quantiles): predictions of the rows with ``train`` false by the models grown on the others.

    ``rows`` has (model, id, train, y, x); each model is grown on its own training rows.
    """
    k = len(alphas)
    table = stored(binned(rows, x, edges(rows, x, features, bins)), "binned")
    trees = Trees(rate)
    quantile = lambda value, a: F.percentile_approx(value, F.lit(float(alphas[a])), ACCURACY)
    starts = table.where("train").groupBy("model").agg(*[quantile("y", a).alias(f"a{a}") for a in range(k)]).collect()  # a row for each model
    known = F.create_map(*[c for r in starts for c in (F.lit(r["model"]), F.array(*[F.lit(r[f"a{a}"]) for a in range(k)]))]) if starts else F.create_map().cast("map<int,array<double>>")
    state = table.withColumns({"margins": F.try_element_at(known, F.col("model")), "leaves": F.array_repeat(F.lit(0), k)}).where("margins is not null")
    for _ in range(rounds):
        trees.splits = {}
        for level in range(depth):
            for r in best_splits(_counted(state, trees, k, level), alphas).collect():  # a row for each node
                trees.splits.setdefault((r["model"], r["a"]), {})[r["node"]] = (r["feature"], r["bin"])
        state = stored(_grown(state, trees, k), "grown")
        trees.values = {}
        residuals = state.where("train").select("model", F.posexplode(F.arrays_zip("margins", "leaves")).alias("a", "m"), "y").select("model", "a", F.col("m.leaves").alias("leaf"), (F.col("y") - F.col("m.margins")).alias("r"))
        at = F.array(*[quantile("r", a) for a in range(k)])
        for r in residuals.groupBy("model", "a", "leaf").agg(at.alias("q")).collect():  # a row for each leaf
            trees.values.setdefault((r["model"], r["a"]), {})[r["leaf"]] = r["q"][r["a"]]
    trees.splits = {}
    last = _grown(state.where("not train"), trees, k)
    missing = table.where("not train").select("model", "id").distinct().join(last.select("model", "id", F.col("margins").alias("quantiles")), ["model", "id"], "left")
    return missing


def spread(rows: DataFrame, x: str, features: int, lo: float = 0.16, hi: float = 0.84, **kw) -> DataFrame:
    """(model, id, lo, hi, spread): two quantiles of the held-out rows and their distance, 0 where they cross."""
    q = fit_predict(rows, x, features, [lo, hi], **kw)
    low, high = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
    return q.select("model", "id", low.alias("lo"), high.alias("hi"), F.greatest(high - low, F.lit(0.0)).alias("spread"))
