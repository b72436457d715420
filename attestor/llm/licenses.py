"""License scans by diagonal voting.

Texts are words (see ``words``).  Every run of ``GRAM`` words of every document gets a rolling hash; Spark joins all hashes
to the positions of the templates' runs.  A hit at word i of the text and word j of the template votes for the diagonal
i - j.  Votes are added up by diagonal, diagonals that an edit may lie between are merged, and each merged bundle that has
the votes of a match within the template's budget of edits is verified: the template is aligned with the words of the
bundle's span by Myers' bit-parallel distance over words, all matches in the span, best first.

A template of m words may have e = ``budget(m)`` edits, at most a fifth of its words.  Each edit spoils ``GRAM`` runs at most,
so a match has m - GRAM + 1 - GRAM * e votes at least, on diagonals at most e apart: no match within the budget is lost.  Of
overlapping matches the most similar one stays, then the longest, so neighbours of a family (CC BY and CC BY-SA) exclude
each other.  Phrases that name a license are found exactly beside that, as base labels, which always stay.

The score is the greatest similarity of a document's matches; a document that only names a license has ``NAMED``, others 0.

The scan is one pass, in which only hits and one header a document are written.  The templates' runs are broadcast up to
``BROADCAST_RUNS``; candidate spans up to ``BROADCAST_SPANS``, else the texts are joined to them by shuffle.  Votes have
partial sums; a document's bundles are as long as the document at most.

Defined results: null and empty texts have no words, no labels, null first and last words and a score of 0; a null doc_id
stays null; repeated rows are reported one by one; a template shorter than ``GRAM`` words is refused; an empty table gives no rows;
columns beside ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.decontaminate import Myers
from attestor.llm.license_texts import NOTICES, PHRASES, TEXTS
from attestor.llm.memory import Remembered
from attestor.llm.storage import Scratch, saved

GRAM = 3
NAMED = 0.5
BROADCAST_RUNS, BROADCAST_SPANS = 200_000, 200_000
#: Bytes that a Python worker remembers of the hashes of words.
ROOM_WORDS = 32 << 20
#: Opens the list of a document's hashes; never the hash of a run.
HEADER = -1
HEADERS = "row long, doc_id long, body long, n_words long, n_base long, first_word long, last_word long, base_labels string"
VERIFIED = "doc_id long, body long, found array<string>, similarity double, spans string"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = bytes(range(ord("0"), ord("9") + 1)) + bytes(range(ord("a"), ord("z") + 1)) + bytes(range(128, 256))
#: A-Z lowered, every byte that is in no word a space; bytes from 128 are those of characters beyond ASCII.
_WORDS = bytes(c if c in _LETTERS else c + 32 if ord("A") <= c <= ord("Z") else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII of a text in UTF-8, A-Z lowered."""
    return text.translate(_WORDS).split()


def budget(m: int) -> int:
    """Edits that a template of m words may have: a fifth, and so few that a run of ``GRAM`` words is left."""
    return min(m // 5, (m - GRAM) // GRAM)


_hashes = Remembered(xxhash.xxh3_64_intdigest, ROOM_WORDS)


def runs(own: Sequence[bytes]) -> np.ndarray:
    """Rolling 64-bit hashes of all runs of ``GRAM`` words."""
    n = len(own) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own))
    h = w[:n].copy()
    for k in range(1, GRAM):
        h = (h ^ (h >> np.uint64(29))) * _PRIME + w[k : n + k]
    return np.where(h == np.uint64(2**64 - 1), np.uint64(0), h).view(np.int64)


class Templates:
    """Words, runs and budgets of the templates, as (label, text)."""

    def __init__(self, texts: Sequence[tuple[str, str]]):
        self.labels = [label for label, _ in texts]
        self.words = [words(t.encode("utf-8")) for _, t in texts]
        if short := [t for (_, t), w in zip(texts, self.words, strict=True) if len(w) < GRAM]:
            raise ValueError(f"templates need {GRAM} words at least: {short}")
        self.budgets = [budget(len(w)) for w in self.words]

    def positions(self) -> list[tuple[int, int, int]]:
        """(hash, template, offset) of every run."""
        return [(h, t, j) for t, w in enumerate(self.words) for j, h in enumerate(runs(w).tolist())]

    def limits(self) -> list[tuple[int, int, int, int]]:
        """(template, words, budget, least votes of a match)."""
        return [(t, len(w), e, len(w) - GRAM + 1 - GRAM * e) for t, (w, e) in enumerate(zip(self.words, self.budgets, strict=True))]


def _phrases(phrases: Sequence[tuple[str, str]]) -> list[tuple[list[bytes], str]]:
    return [(words(p.encode("utf-8")), label) for p, label in phrases]


def base_places(own: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after the other."""
    found = []
    for phrase, label in phrases:
        at = -1
        last = len(own) - len(phrase)
        try:
            while True:
                at = own.index(phrase[0], at + 1)
                if at <= last and own[at : at + len(phrase)] == phrase:
                    found.append((at, label))
        except ValueError:
            pass
    return found


def hits(docs: DataFrame, templates: Templates, phrases: Sequence[tuple[str, str]], scratch: Scratch) -> DataFrame:
    """A header of each row of ``docs`` (at = 0) and its hits (at - 1 is the first word, with template and offset), stored."""
    spark, listed = docs.sparkSession, _phrases(phrases)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                heads, grams = [], []
                for text in b.column(3).to_pylist():
                    own = words(text)
                    places = base_places(own, listed)
                    at = [i for i, _ in places]
                    heads.append((len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
                    grams.append(np.concatenate([np.array([HEADER], np.int64), runs(own)]))
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*heads, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns, lists], [*(c.split()[0] for c in HEADERS.split(", ")), "runs"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.cast("binary").alias("text"))
    own = [c.split()[0] for c in HEADERS.split(", ")]
    each = rows.mapInArrow(scanned, f"{HEADERS}, runs array<long>").select(*own, F.posexplode("runs").alias("at", "run"))
    known = templates.positions()
    positions = spark.createDataFrame(known, "run long, template int, offset int")
    met = each.join(F.broadcast(positions) if len(known) <= BROADCAST_RUNS else positions, "run", "left")
    met = met.where("at = 0 or template is not null").drop("run")
    return scratch.saved(met, "hits")


def bundles(met: DataFrame, templates: Templates, scratch: Scratch) -> DataFrame:
    """(doc_id, body, spans): per text the spans (template, low, high, in words) that have a match's votes, stored."""
    limits = F.broadcast(met.sparkSession.createDataFrame(templates.limits(), "template int, size int, edits int, least int"))
    diagonals = met.where("template is not null").groupBy("row", "doc_id", "body", "template", (F.col("at") - 1 - F.col("offset")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = diagonals.join(limits, "template").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.col("edits")).cast("int"), F.lit(0)))
    merged = apart.withColumn("bundle", F.sum("new").over(order)).groupBy("row", "doc_id", "body", "template", "bundle", "least").agg(
        F.sum("votes").alias("votes"), (F.min("diagonal") - F.max("edits")).alias("low"), (F.max("diagonal") + F.max("size") + F.max("edits")).alias("high")
    )
    strong = merged.where("votes >= least").select("doc_id", "body", F.struct("template", "low", "high").alias("span"))
    return scratch.saved(strong.groupBy("doc_id", "body").agg(F.collect_set("span").alias("spans")), "bundles")


def matches_in(own: list[bytes], low: int, high: int, template: list[bytes], edits: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of all matches of a template within words[low:high], none overlapping another, best first."""
    low, high, found = max(low, 0), min(high, len(own)), []
    ahead, back = Myers(template), Myers(template[::-1])
    todo = [(low, high)]
    while todo:
        a, b = todo.pop()
        if b - a < len(template) - edits:
            continue
        distance, end = ahead.best(own, a, b)
        if distance > edits:
            continue
        start = max(a, end - len(template) - edits)
        _, size = back.best(own[start:end][::-1], 0, end - start)
        start = end - size
        found.append((distance, start, end))
        todo += [(a, start), (end, b)]
    return found


def settled(found: list[tuple[float, int, int, str]]) -> list[tuple[float, int, int, str]]:
    """Of overlapping matches (similarity, start, end, label) the most similar, then the longest, then the first."""
    starts, kept = [], []
    for x in sorted(set(found), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        i = bisect_right(starts, x[1])
        if i and kept[i - 1][2] > x[1] or i < len(kept) and kept[i][1] < x[2]:
            continue
        starts.insert(i, x[1])
        kept.insert(i, x)
    return kept


def verified(docs: DataFrame, candidates: DataFrame, templates: Templates) -> DataFrame:
    """(doc_id, body, found, similarity, spans) of the texts that hold a match."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, body, text, spans in zip(b["doc_id"], b["body"], b["text"], b["spans"], strict=True):
                own, found = words(bytes(text)), []
                for span in spans:
                    t = span["template"]
                    size = len(templates.words[t])
                    found += [(1 - d / size, start, end, templates.labels[t]) for d, start, end in matches_in(own, span["low"], span["high"], templates.words[t], templates.budgets[t])]
                if kept := settled(found):
                    rows.append((doc, body, sorted({x[3] for x in kept}), max(x[0] for x in kept), ",".join(f"{x[3]}:{x[1]}:{x[2]}" for x in kept)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in VERIFIED.split(", ")]).astype({"doc_id": "Int64"})

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.cast("binary").alias("text"))
    some = candidates.withColumnsRenamed({"doc_id": "doc", "body": "hash"})
    size = candidates.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    both = rows.join(F.broadcast(some) if size <= BROADCAST_SPANS else some, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("body") == F.col("hash")))
    return both.select("doc_id", "body", "text", "spans").mapInPandas(verify, VERIFIED).dropDuplicates(["doc_id", "body"])


def scan(docs: DataFrame, texts: Sequence[tuple[str, str]] = (*NOTICES, *TEXTS), phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of ``docs``, stored.

    ``spans`` lists the verified matches as label:start:end in words, comma-joined, by start.
    """
    templates = Templates(texts)
    with Scratch(docs.sparkSession, "licenses") as scratch:
        met = hits(docs, templates, phrases, scratch)
        found = scratch.saved(verified(docs, bundles(met, templates, scratch), templates), "verified").withColumnsRenamed({"doc_id": "doc", "body": "hash"})
        heads = met.where("at = 0").join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("body") == F.col("hash")), "left")
        named = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
        labels = F.concat_ws(",", F.array_sort(F.array_union(named, F.coalesce("found", F.array().cast("array<string>")))))
        score = F.coalesce("similarity", F.when(F.col("n_base") > 0, F.lit(NAMED)).otherwise(F.lit(0.0)))
        out = heads.select(
            "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), F.coalesce("spans", F.lit("")).alias("spans")
        )
        return saved(out, "licenses")
