"""Quality classifier: histogram boosted trees over document statistics.

Statistics cover the whole text: sizes, shares of character classes, words and their repetition, lines, and marks at word
ends.  Defined results: null and empty texts have all statistics 0 and are scored like any other; without usable labels
every document gets 0; repeated rows are scored one by one.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import boosting
from attestor.llm.labelled import sample

STATISTICS = (
    "log_chars log_words mean_word distinct_words top_word repeats distinct_pairs upper lower_ascii digits spaces newlines marks symbols other_bytes"
    " byte_entropy upper_words marked_words symbol_words lone_marks log_lines mean_line distinct_lines long_word stops max_run"
).split()


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, words, lines = len(raw), text.split(), text.split("\n")
    n = max(len(words), 1)
    share = byte[byte > 0] / size
    known = Counter(words)
    following = list(map(operator.eq, words, words[1:]))
    longest = run = 1 if words else 0
    if any(following):
        for same in following:
            run = run + 1 if same else 1
            longest = max(longest, run)
    ends = Counter(w[-1] for w in words)
    marked = sum(c for k, c in ends.items() if not k.isalnum())
    symbols = sum(c for k, c in ends.items() if k in "!*#$%&@^~|<>=+\\/_")
    marks = int(byte[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    upper, lower, digits = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[48:58].sum())
    lone = sum(c for w, c in known.items() if len(w) == 1 and not w.isalnum())
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, len(known) / n, max(known.values(), default=0) / n, sum(following) / n,
        len(set(zip(words, words[1:], strict=False))) / n, upper / size, lower / size, digits / size, int(byte[32]) / size, int(byte[10]) / size,
        marks / size, (int(byte[33:127].sum()) - marks - upper - lower - digits) / size, int(byte[128:].sum()) / size,
        float(-(share * np.log2(share)).sum()), sum(map(str.isupper, words)) / n, marked / n, symbols / n, lone / n,
        np.log1p(len(lines)), len(text) / len(lines), len(set(lines)) / len(lines), max(map(len, words), default=0), ends["."] / n, longest / n,
    ]


def table(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float32).astype(float).reshape(len(texts), len(STATISTICS))


def fit(train: DataFrame, trees: int = 80, depth: int = 4) -> boosting.Forest:
    """Learn from a bounded sample (doc_id, y, text)."""

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = table(b["text"]).astype(np.float32)
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"].astype("int32"), "x": [r.tobytes() for r in x]})

    rows = train.mapInPandas(numbers, "doc_id long, y int, x binary").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), len(STATISTICS)).astype(float)
    return boosting.fit(x, (rows["y"].to_numpy() > 0).astype(float), trees=trees, depth=depth)


def score(docs: DataFrame, forest: boosting.Forest, out: str = "score") -> DataFrame:
    """(doc_id, ``out``) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], out: shared.value.probability(table(b["text"]))})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(scored, f"doc_id long, {out} double")


def train_and_score(docs: DataFrame, labels: DataFrame, keep=None, max_rows: int = 16_000) -> DataFrame:
    """Fit on labelled rows for which ``keep`` (a condition on labels.doc_id) holds and score all of ``docs``."""
    keep = F.lit(True) if keep is None else keep
    return score(docs, fit(sample(docs, labels, "quality", keep, max_rows)))
