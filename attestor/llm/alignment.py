"""Cross-tokenizer alignment: two tokenizers over the same bytes, merged where their tokens end together.

A encodes a space and the text by byte-level BPE, B the text by pieces, which puts that space there itself.  Both cover the
same bytes, so two ascending lists of token ends are merged by two pointers; every common end closes a group and links the
two tokens that end there.  Texts are merged unit by unit: a unit is a run of white space with the words after it, and is
cut where neither tokenizer has a token across the cut (see ``Pair``), so units recur and their merges are remembered.

The merge emits for every document its digest of groups and its links as (pair of ids, number).  Spark counts the pairs over
the corpus, takes the highest count of each id on both sides, and joins both back to the documents' links.  A pair comes once
a document, already counted there; sums have partial aggregates before each shuffle.  The table of pairs is broadcast if
it has at most ``BROADCAST_PAIRS`` rows; beyond, pairs in more than a thousandth of all rows (a thousand pairs at
most) are broadcast and the others joined by shuffle, so no key weighs more than a thousandth.

Defined results: null and empty texts, and texts whose bytes one tokenizer doesn't give back (U+2581, for one), have no
tokens and all counts 0; a null doc_id stays null; repeated rows count each by themselves, in the corpus too; strings
of special tokens are ordinary text; an empty table gives no rows; columns beside ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.bpe import PLAIN, PLAIN_PATTERN, UNUSUAL
from attestor.llm.memory import Remembered
from attestor.llm.storage import Scratch, saved
from attestor.llm.token_files import BYTE_SIGNS

#: Bytes that a Python worker remembers of merged units, and of A's matches within them.
ROOM_UNITS, ROOM_MATCHES = 192 << 20, 32 << 20
#: Pairs that are broadcast at once, of 40 bytes or so each.
BROADCAST_PAIRS = 1_000_000
#: Spaces and line ends after a word open a unit; other white space may be in the middle of one of B's pieces.
LONG_UNIT = r"\s*\S+(?:(?![ \n\t])\s+\S*)*|\s+"
#: Letters that all versions of Unicode know as such, and marks that may follow them.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ",.;:!?)"
MERGED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_SPACE = "▁"


def two_pointers(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """(i, j) of the tokens of both lists, which hold the same bytes, that end together."""
    i, j, end_a, end_b, common = 0, 0, len(a[0]), len(b[0]), []
    while True:
        if end_a < end_b:
            i += 1
            end_a += len(a[i])
        elif end_b < end_a:
            j += 1
            end_b += len(b[j])
        else:
            common.append((i, j))
            i += 1
            j += 1
            if i == len(a):
                return common
            end_a += len(a[i])
            end_b += len(b[j])


class Pair:
    """Both tokenizers, and the merges of units.

    A's pattern never joins a letter with white space or a mark after it, nor a line end with a letter.  B merges neighbours
    into pieces of its vocabulary alone, so none of its tokens crosses a place whose two characters no piece has side by
    side; ``Pair`` looks through the vocabulary for the marks that never follow a letter, and takes each text as one unit if
    white space follows other characters in some piece.  No piece has a line end, so a unit is encoded behind one.
    """

    def __init__(self, path_a: str, path_b: str, pattern: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.plain = PLAIN if pattern == PLAIN_PATTERN else None
        byte_of = {sign: b for b, sign in BYTE_SIGNS.items()}
        self.bytes_a = {i: bytes(byte_of[c] for c in token) for token, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in token)}
        pieces = ["" if self.b.is_byte(i) else self.b.id_to_piece(i).replace(_SPACE, " ") for i in range(self.b.get_piece_size())]
        self.bytes_b = [p.encode("utf-8") or bytes([int(self.b.id_to_piece(i)[3:5], 16)]) for i, p in enumerate(pieces)]
        whole = "".join(f"\0{p}\0" for p in pieces)
        self.by_unit = "\n" not in whole and not re.search(r"[^\s\0][ \n\t]", whole)
        marks = "".join(m for m in MARKS if not re.search(f"[{LETTERS}]{re.escape(m)}", whole))
        self.unit = re.compile(rf"\n(?=[{LETTERS}])|\s*[{LETTERS}]+(?=[ \n\t{re.escape(marks)}])|{LONG_UNIT}")
        self.head = len(self.b.encode("\n"))
        self.matches = Remembered(self._match, ROOM_MATCHES, lambda ids: 60 + 40 * len(ids))
        self.units = Remembered(self._unit, ROOM_UNITS, lambda unit: 64 + sum(map(sys.getsizeof, unit)))

    def _match(self, match: str) -> tuple[int, ...]:
        signs = "".join(map(BYTE_SIGNS.__getitem__, match.encode("utf-8")))
        return tuple(t.id for t in self.a.model.tokenize(signs))

    def ids_a(self, text: str) -> list[int]:
        """A's ids of a text; unusual characters go through the library's own pattern."""
        if not self.plain or UNUSUAL.search(text):
            return self.a.encode(text, add_special_tokens=False).ids
        return [i for m in self.plain.findall(text) for i in self.matches[m]]

    def ids_b(self, unit: str) -> list[int]:
        return self.b.encode("\n" + unit)[self.head :] if self.by_unit else self.b.encode(unit[1:])

    def _unit(self, unit: str) -> tuple:
        """Groups as written in the digest, links as packed pairs, and both numbers of tokens; empty if bytes differ."""
        a, b = self.ids_a(unit), self.ids_b(unit)
        own_a, own_b, raw = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b], unit.encode("utf-8")
        if b"".join(own_a) != raw or b"".join(own_b) != raw:
            return ()
        if len(a) == 1 or len(b) == 1:
            common = ((len(a) - 1, len(b) - 1),)
        else:
            common = two_pointers(own_a, own_b)
        groups, links, i, j = [], array("q"), 0, 0
        for x, y in common:
            groups.append(f"{a[i]}|{b[j]}" if x == i and y == j else ",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            links.append(a[x] << 32 | b[y])
            i, j = x + 1, y + 1
        return ";".join(groups).encode(), links.tobytes(), len(a) << 32 | len(b)

    def merge(self, text: str) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_links, groups_sha256, pairs, times) of one text; each link closes a group."""
        whole = " " + text
        units = list(map(self.units.__getitem__, self.unit.findall(whole) if self.by_unit else [whole])) if text else [()]
        if not all(units):
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        groups, links, sizes = zip(*units, strict=True)
        pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
        n = sum(sizes)
        return n >> 32, n & 0xFFFFFFFF, int(times.sum()), hashlib.sha256(b";".join(groups)).hexdigest(), pairs, times


@functools.cache
def pair(path_a: str, path_b: str, pattern: str) -> Pair:
    """One for each Python worker."""
    return Pair(path_a, path_b, pattern)


def merge(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """Groups and links of every document (``MERGED``): a pair of ids is A's in the upper 32 bits and B's in the lower."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pair(path_a, path_b, pattern)
        for batch in batches:
            for at in range(0, len(batch), 500):
                b = batch.iloc[at : at + 500]
                n_a, n_b, n_links, digests, pairs, times = zip(*map(p.merge, b["text"]), strict=True)
                yield pd.DataFrame({
                    "row": b["row"].to_numpy(), "doc_id": b["doc_id"].to_numpy(), "n_a": n_a, "n_b": n_b, "n_groups": n_links, "n_links": n_links,
                    "groups_sha256": digests, "pairs": pairs, "times": times,
                })

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(merged, MERGED)


def count_pairs(links: DataFrame) -> DataFrame:
    """(pair, count, rows, best_a, best_b): how often each pair is linked, in how many rows, and its ids' highest counts."""
    pairs = links.groupBy("pair").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("rows"))
    pairs = pairs.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(0xFFFFFFFF)})
    best_a = pairs.groupBy("a").agg(F.max("count").alias("best_a"))
    best_b = pairs.groupBy("b").agg(F.max("count").alias("best_b"))
    return pairs.join(best_a, "a").join(best_b, "b").select("pair", "count", "rows", "best_a", "best_b")


def _joined(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``links`` with the counts of their pairs; rows without a pair (of empty documents) stay."""
    size = counts.agg(F.count(F.lit(1)).alias("pairs"), F.sum("rows").alias("rows")).first()
    if size["pairs"] <= BROADCAST_PAIRS:
        return links.join(F.broadcast(counts), "pair", "left")
    hot = counts.where(F.col("rows") * 1000 > size["rows"])  # fewer than 1000
    keys = hot.select("pair", F.lit(True).alias("hot"))
    marked = links.join(F.broadcast(keys), "pair", "left")
    some = marked.where("hot").drop("hot").join(F.broadcast(hot), "pair")
    rest = marked.where("hot is null and pair is not null").drop("hot").join(counts, "pair")
    none = links.where("pair is null").join(counts.where("false"), "pair", "left")
    return some.unionByName(rest).unionByName(none)


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_both) of every row of ``docs``, stored.

    ``n_best`` counts links whose pair is the most frequent one of its B id, ``n_best_both`` those that are so for both ids.
    """
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    with Scratch(docs.sparkSession, "alignment") as scratch:
        merged = scratch.saved(merge(docs, path_a, path_b, pattern), "merged")
        each = F.arrays_zip("pairs", "times")
        counts = scratch.saved(count_pairs(merged.select(F.explode(each).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))), "pairs")
        links = merged.select(*own, F.explode_outer(each).alias("x")).select(*own, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        found = _joined(links, counts).groupBy(*own).agg(
            F.coalesce(F.sum(F.when(F.col("count") == F.col("best_b"), F.col("times"))), F.lit(0)).cast("long").alias("n_best"),
            F.coalesce(F.sum(F.col("count") * F.col("times")), F.lit(0)).cast("long").alias("count_sum"),
            F.coalesce(F.sum(F.when((F.col("count") == F.col("best_b")) & (F.col("count") == F.col("best_a")), F.col("times"))), F.lit(0)).cast("long").alias("n_best_both"),
        )
        return saved(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_both"), "aligned")
