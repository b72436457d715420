"""Byte-level BPE as a tree reduction, and its decoding.

The pattern's matches are independent of each other, so a text is the concatenation of its encoded matches: its list of
matches is halved recursively and the halves' ids are joined on the way up.  A match is a tree of its own, cut in halves
down to single bytes.  Neighbours are joined by encoding a window around their seam anew, which grows until the tokens at
both of its ends are stable.  A pair of neighbouring tokens is stable when encoding their bytes gives just that pair; a
sequence whose neighbours are all stable is the encoding of its bytes, because a merge that could change it would have to
start between two of its tokens.  Hence nothing outside the window can change.  Decoding concatenates the tokens' bytes
up a tree of the ids, which is associative and needs no seams.

Words and their parts recur, so each Python worker remembers matches, subtrees, windows and stable pairs, within bounds
in bytes.

Defined results: a null text is empty and has no tokens; rows are encoded one by one, also repeated ones; a match of any
length is encoded whole; letters and digits are those of the regex module's version of Unicode; lone surrogates can't
occur in Spark's strings; an empty table gives no rows; columns beside ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.memory import Remembered

NO_RANK = 1 << 40
#: Bytes that a Python worker's memories of each kind may take.
ROOM_MATCHES, ROOM_PARTS, ROOM_WINDOWS, ROOM_PAIRS = 64 << 20, 16 << 20, 24 << 20, 24 << 20
#: Parts of at most so many bytes are remembered; longer ones seldom recur outside the matches themselves.
SHORT = 6
#: So many neighbours are concatenated at once at the leaves of the trees over matches and over ids.
LEAVES = 256


# A pattern of the standard library that finds the same matches as PLAIN_PATTERN, twice as fast, in texts
# without the characters of UNUSUAL (numbers that are no digits, separators that only one library takes for white space,
# and all beyond the Latin letters, whose classes depend on a library's version of Unicode).
PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]")


def up_the_tree(leaves: Sequence, of: Callable[[object], bytes]) -> bytes:
    """The concatenation of ``of`` each leaf: of both halves first, then of the two."""
    if len(leaves) <= LEAVES:
        return b"".join(map(of, leaves))
    half = len(leaves) // 2
    return up_the_tree(leaves[:half], of) + up_the_tree(leaves[half:], of)


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Ranks of one vocabulary file and the reductions over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.plain = PLAIN if pattern == PLAIN_PATTERN else None
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pairs = Remembered(self._stable, ROOM_PAIRS)
        self.parts, self.windows = Remembered(self._halves, ROOM_PARTS), Remembered(self.merged, ROOM_WINDOWS)
        self.matches = Remembered(self._match, ROOM_MATCHES)

    def merged(self, piece: bytes) -> list[int]:
        """Merge adjacent parts, least rank first and leftmost among equals, until nothing merges."""
        ranks = self.ranks
        if len(piece) > 64:
            return self._merged_by_heap(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) != NO_RANK:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], NO_RANK)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], NO_RANK)
        return [ranks[p] for p in parts]

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = ranks.get(piece[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[j]))

        heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _stable(self, pair: tuple[int, int]) -> bool:
        return self.merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes together."""
        pairs, window = self.pairs, 1
        if pairs[left[-1], right[0]]:
            return left + right
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            middle = self.windows[b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))]
            if (i == 0 or pairs[left[i - 1], middle[0]]) and (j == len(right) or pairs[middle[-1], right[j]]):
                return left[:i] + middle + right[j:]
            window *= 2

    def _halves(self, piece: bytes) -> list[int]:
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:])) if half else [self.ranks[piece]]

    def tree(self, piece: bytes) -> list[int]:
        """Halves first, then their join."""
        return self.parts[piece] if len(piece) <= SHORT else self._halves(piece)

    def _match(self, match: str) -> bytes:
        """The packed ids of one match of the pattern; a match that is a token itself stays whole."""
        piece = match.encode("utf-8")
        whole = self.ranks.get(piece)
        return _packed(self.tree(piece) if whole is None else [whole])

    def encode(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        pattern = self.plain if self.plain and not UNUSUAL.search(text) else self.pattern
        return up_the_tree(pattern.findall(text), self.matches.__getitem__)

    def decode(self, ids: Sequence[int] | np.ndarray) -> bytes:
        return up_the_tree(ids.tolist() if isinstance(ids, np.ndarray) else ids, self.bytes_of.__getitem__)


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the packed ids of each whole text."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [e.encode(t) for t in b["text"]]})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(encoded, "doc_id long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded again."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary, pattern)
        for b in batches:
            coded = [e.encode(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_tokens": [len(c) // 4 for c in coded], "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
                "decoded_sha256": [hashlib.sha256(e.decode(np.frombuffer(c, "<u4"))).hexdigest() for c in coded],
            })

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
