"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the text ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows (doc_id, y, text) of labelled documents for which ``keep`` holds.

    The rows with the smallest hash of their id are taken, so the choice depends on ids alone.  Rows without an id or a
    label are left out; an id with several labels is positive if any of them is.  Only the chosen ids (``max_rows`` at
    most) are broadcast.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
