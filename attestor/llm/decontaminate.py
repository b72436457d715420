"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and their white space is squashed.  An item of m characters may occur in a document with up to
k = m * rate edits.  Cut in k + 1 pieces, at least one piece then occurs exactly; all pieces of a block of items form one
Aho-Corasick automaton that scans every whole document.  Around each hit the item is aligned with Myers' bit-parallel
algorithm, whose least distance decides.

Items are taken in blocks of bounded size (``BLOCK_CHARS``), each broadcast on its own, so a large benchmark means more
passes, not more memory.  A Python worker keeps the automaton of its last block.  Documents are never shuffled.

Items under ``least`` characters say little with edits; they are found as they are, without edits and as whole words.

Defined results: null texts are empty and match nothing; null and empty items are found nowhere; a null item id stays null;
repeated items and rows each count by themselves; an empty table on either side gives no matches; other columns are
left out of matches and kept by ``without_matches``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 4_000_000
MATCHES = "doc_id long, item_id long, distance int, start int, end int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    """Edits that an item of so many characters may have."""
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``item`` cut into k + 1 parts of nearly equal length, with their offsets."""
    cut = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Myers:
    """The least edit distance between a pattern and any substring of a text."""

    def __init__(self, pattern: str):
        self.length, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, start: int, end: int) -> tuple[int, int]:
        """(distance, end of the first best match) within text[start:end]."""
        top, full = 1 << (self.length - 1), (1 << self.length) - 1
        plus, minus, score = full, 0, self.length
        best, at = score, start
        masks = self.masks
        for i in range(start, end):
            eq = masks.get(text[i], 0)
            d0 = (((eq & plus) + plus) ^ plus) | eq | minus
            hp = minus | (full & ~(d0 | plus))
            hn = d0 & plus
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp, hn = hp << 1 & full, hn << 1 & full
            plus, minus = hn | (full & ~(d0 | hp)), hp & d0
            if score < best:
                best, at = score, i + 1
        return best, at


def _joined(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word; scripts that put no spaces between words have none."""
    return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"


def _whole_words(text: str, start: int, end: int) -> bool:
    return not (start and _joined(text[start - 1], text[start])) and not (end < len(text) and _joined(text[end - 1], text[end]))


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, least: int):
        self.items, self.least, self.budgets = items, least, [budget(len(t), rate) if len(t) >= least else 0 for _, t in items]
        self.myers = [Myers(t) for _, t in items]
        self.automaton = ahocorasick.Automaton()
        for n, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.budgets[n]):
                known = self.automaton.get(piece, None)
                if known is None:
                    self.automaton.add_word(piece, (len(piece), [(n, offset)]))
                else:
                    known[1].append((n, offset))
        if items:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item number to (distance, start, end) of its best match; start is where a match without edits would begin."""
        found: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                item, k = self.items[n][1], self.budgets[n]
                begin = last + 1 - size - offset
                if begin < -k or begin + len(item) > len(text) + k or n in found and not found[n][0]:
                    continue
                if text.startswith(item, max(begin, 0)) and begin >= 0:
                    if len(item) < self.least and not _whole_words(text, begin, begin + len(item)):
                        continue
                    found[n] = (0, begin, begin + len(item))
                    continue
                if not k or (n, begin) in tried:
                    continue
                tried.add((n, begin))
                start, end = max(0, begin - k), min(len(text), begin + len(item) + k)
                distance, stop = self.myers[n].best(text, start, end)
                if distance <= k and (n not in found or distance < found[n][0]):
                    found[n] = (distance, max(0, stop - len(item)), stop)
        return found


_last: list = [None, None, None]


def matcher(items: Broadcast, rate: float, least: int) -> Matcher:
    """The automaton of a broadcast block, kept in the Python worker until another one is asked for."""
    value = items.value
    if _last[0] is not value or _last[1] != (rate, least):
        _last[:] = value, (rate, least), Matcher(value, rate, least)
    return _last[2]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in order of their ids, in blocks of at most ``BLOCK_CHARS`` characters (or one longer item)."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        item = normal(r["text"])
        if item:
            if block and size + len(item) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((r["item_id"], item))
            size += len(item)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, least: int = 24) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best match of each item that a document holds, in normalised text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCHES)
    for block in blocks(benchmark):
        items = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            m = matcher(items, rate, least)
            for b in batches:
                rows = []
                for doc, text in zip(b["doc_id"], b["text"], strict=True):
                    for n, (distance, start, end) in m.find(normal(text)).items():
                        rows.append((None if pd.isna(doc) else doc, items.value[n][0], distance, start, end))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "end"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        out = out.unionByName(texts.mapInPandas(search, MATCHES))
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, least: int = 24) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item."""
    kept = docs
    for block in blocks(benchmark):
        kept = kept.where(_clean(docs.sparkSession.sparkContext.broadcast(block), rate, least)(F.col("text")))
    return kept


def _clean(items: Broadcast, rate: float, least: int):
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = matcher(items, rate, least)
        for t in texts:
            yield pd.Series([not m.find(normal(x)) for x in t], dtype=bool)

    return clean
