"""Near-duplicate classes by Order MinHash, verified by banded alignment.

The k-mers of a text are its runs of five lower-case words, each labelled with its occurrence number.  A sketch takes the
``SIZE`` k-mers with the least hashes under one permutation and keeps them in the order of the text, so it agrees for texts
that are close in edit distance, not merely in vocabulary.  ``SKETCHES`` such sketches are the bucket keys of a text.

Two texts are linked if their k-mer sequences align with M matches such that M / (n1 + n2 - M) >= 0.8.  That bounds how far
an alignment may leave the diagonal, so the alignment is computed in a band of that width.

Copies (equal word sequences) are merged first.  Each bucket's texts are compared with its leader, the text that shares
most buckets with others, which for a family of copies is the one closest to its origin, and linked texts form
components.  Only buckets that then still hold several components can lack links.  Their texts are treated exactly:

* A k-mer that no other component has can't be matched by any link that is left.  With so many k-mers lost, most texts
  can be shown to have no further link, and need no partners.
* The others get finer sketches (``FINE`` k-mers, more of them), whose buckets seldom hold texts below 0.8, and every two
  texts of such a bucket from different components are compared, unless the lost k-mers alone keep them below 0.8.

So the number of comparisons follows the number of texts where families hold together or fall apart, and no pair is left
out by a cap.  Classes are the connected components of all links.  Buckets may hold a third of all texts: their rows are
dealt to blocks of bounded size before they meet their leader or each other.  Joins leave it to Spark whether a side is
small enough to be broadcast (by the size of the stored table).

Sketches alone tell little of a short text.  Texts of at most ``EXACT`` k-mers therefore also have a key for each sequence
that is left without up to a fifth of their k-mers, which finds every link among them, and texts of at most ``FEW`` k-mers
have twice as many sketches.  So a link at exactly 0.8 is in a common bucket with a chance of over 0.9999 whatever the
length of its texts, and in a finer one with 0.995 (texts of 32 k-mers) to 0.9998 (long ones); texts below ``COARSE``
k-mers use their first buckets again.  The recall of classes is measured in the tests.

Defined results: null and empty texts and those of white space have no k-mers and are classes of their own; texts of one
to four words have one k-mer, all their words; a class is named by its smallest doc_id (null ids come last); of repeated
rows one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.memory import Remembered
from attestor.llm.storage import Scratch, saved

WORDS = 5
SKETCHES, SIZE = 28, 5
#: Texts of at most ``EXACT`` k-mers also have exact keys, those of at most ``FEW`` twice as many sketches.
EXACT, FEW = 10, 15
#: Finer sketches: their k-mers and their number, twice as many for texts below ``MANY`` k-mers.  Texts of ``COARSE`` k-mers
#: or fewer use the first ones; those within 0.8 of that bound have both, so that any two have one kind in common.
FINE, FINE_SKETCHES, MANY, COARSE = 16, 300, 100, 40
#: So many texts of a bucket at most (on average) share one key when they meet their leader, and when all pairs are formed.
LED, BLOCK = 4096, 256
#: So many texts or pairs are unpacked at once in a Python worker.
UNPACKED = 256
#: Bytes that a Python worker remembers of the hashes of words.
ROOM_WORDS = 16 << 20
_ODD = np.random.default_rng(2020).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The multipliers of the permutations of both kinds of sketches.
_PERMUTATIONS = [np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed, n in ((2021, 2 * SKETCHES), (2022, 2 * FINE_SKETCHES))]
_PAIRS = "row long, leader long, linked boolean"


_hashes = Remembered(xxhash.xxh32_intdigest, ROOM_WORDS)


def words(text: str | None) -> np.ndarray:
    """32-bit hashes of the lower-case words in order."""
    known = (text or "").lower().split()
    return np.fromiter(map(_hashes.__getitem__, known), np.uint32, len(known))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[250]
    return x ^ (x >> np.uint64(29))


def kmers(w: np.ndarray) -> np.ndarray:
    """64-bit hashes of the five-word runs, each with its occurrence number mixed in."""
    if not len(w):
        return np.zeros(0, np.uint64)
    k = min(WORDS, len(w))
    n, wide = len(w) - k + 1, w.astype(np.uint64)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s += _mix(wide[j : j + n] + _ODD[j]) * _ODD[100 + j]
    s = _mix(s)
    order = np.argsort(s, kind="stable")
    same = s[order][1:] == s[order][:-1]
    if same.any():
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(np.r_[True, ~same], at, 0))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = (at - start).astype(np.uint64)
        s = np.where(occurrence > 0, _mix(s + occurrence * _ODD[99]), s)
    return s


@cache
def _subsets(n: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n), size)))


def shortened(s: np.ndarray) -> np.ndarray:
    """One key for each sequence that is left of ``s`` without up to a fifth of its k-mers.

    Two linked texts share M k-mers in order with M >= 0.8 of each one's count, so they share the key of those M.
    """
    keys = []
    for gone in range(len(s) // 5 + 1):
        left = _subsets(len(s), len(s) - gone)
        keys.append((s[left] * _ODD[120 : 120 + len(s) - gone]).sum(axis=1, dtype=np.uint64))
    return np.unique(_mix(np.concatenate(keys)))


def sketches(s: np.ndarray) -> np.ndarray:
    """The bucket keys of one text."""
    if not len(s):
        return np.zeros(0, np.int64)
    exact = shortened(s).view(np.int64) if len(s) <= EXACT else np.zeros(0, np.int64)
    if len(s) <= SIZE:
        return exact
    return np.concatenate([exact, _sketched(s, SIZE, SKETCHES if len(s) > FEW else 2 * SKETCHES, 0)])


def fine_sketches(s: np.ndarray) -> np.ndarray:
    """The finer keys of one text, see ``COARSE``."""
    coarse = sketches(s) if len(s) <= COARSE else np.zeros(0, np.int64)
    if 5 * len(s) < 4 * COARSE:
        return coarse
    return np.concatenate([coarse, _sketched(s, FINE, FINE_SKETCHES if len(s) >= MANY else 2 * FINE_SKETCHES, 1)])


def _sketched(s: np.ndarray, size: int, count: int, kind: int) -> np.ndarray:
    """``count`` keys of the ``size`` least k-mers in the order of the text, under the permutations of one kind."""
    odd = _PERMUTATIONS[kind]
    found, step = [], max(1, 2_000_000 // len(s))  # so many permutations at once that long texts take no more room
    for i in range(0, count, step):
        order = (s[None, :] * odd[i : min(i + step, count), None]) >> np.uint64(32)
        found.append(np.argpartition(order.astype(np.uint32), size - 1, axis=1)[:, :size])
    least = np.sort(np.concatenate(found), axis=1)
    keys = (s[least] * _ODD[120 : 120 + size]).sum(axis=1, dtype=np.uint64) + odd[:count] * _ODD[251]
    return _mix(keys).view(np.int64)


def banded_matches(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence among alignments that stay within ``band`` of the diagonal.

    Bit-parallel over ``a``: bit i of ``row`` is 0 where the best alignment of a[:i + 1] gains a match.
    """
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, width = full, (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b.tolist()):
        hit = where.get(x, 0) & (width << (j - band) if j >= band else width >> (band - j))
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two k-mer sequences align with a similarity of 0.8 or more."""
    total = len(a) + len(b)
    need = -(-4 * total // 9)  # M / (total - M) >= 4 / 5
    if min(len(a), len(b)) < need:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    a, b, m = a[head:], b[head:], m - head
    differ = np.flatnonzero(a[len(a) - m :] != b[len(b) - m :]) if m else []
    tail = m - 1 - int(differ[-1]) if len(differ) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    common = np.intersect1d(a, b, assume_unique=True)
    if head + tail + len(common) < need:
        return False
    inner_a, inner_b = a[np.isin(a, common)], b[np.isin(b, common)]
    if np.array_equal(inner_a, inner_b):
        return True
    return head + tail + banded_matches(a, b, total - 2 * need) >= need


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, UNPACKED):
            yield b.slice(at, UNPACKED)


def _base(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, copy, bands, words) of every row, stored."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            w = [words(t) for t in b.column(2).to_pylist()]
            copy = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in w], pa.binary())
            bands = pa.array([sketches(kmers(x)) for x in w], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), copy, bands, pa.array([x.tobytes() for x in w], pa.binary())], ["row", "doc_id", "copy", "bands", "words"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.saved(rows.mapInArrow(sketched, "row long, doc_id long, copy binary, bands array<long>, words binary"), "sketches")


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, leader, linked) for candidate pairs (row, leader)."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            known: dict[int, np.ndarray] = {}
            out = []
            for leader, x, y in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if leader not in known:
                    known[leader] = kmers(np.frombuffer(y, np.uint32))
                out.append(linked(kmers(np.frombuffer(x, np.uint32)), known[leader]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["row", "leader", "linked"])

    leaders = texts.select(F.col("row").alias("leader"), F.col("words").alias("leader_words"))
    both = pairs.join(texts, "row").join(leaders, "leader")
    return scratch.saved(both.select("row", "leader", "words", "leader_words").mapInArrow(aligned, _PAIRS), "aligned")


def links(base: DataFrame, texts_of: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all linked texts; ``texts_of`` has the row of each different text.  Drops both tables."""
    kmer_count = F.greatest(F.length("words") / 4 - (WORDS - 1), F.lit(1)).cast("int").alias("kmers")
    exploded = base.select("row", "bands", kmer_count).join(texts_of, "row", "left_semi").select("row", "kmers", F.explode("bands").alias("band"))
    sizes = scratch.saved(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    shared = scratch.saved(exploded.join(sizes, "band"), "shared")
    weight = scratch.saved(shared.groupBy("row").agg(F.sum("n").alias("weight")), "weights")
    texts = scratch.saved(base.select("row", "words").join(weight, "row", "left_semi"), "texts")
    scratch.drop(base, texts_of, sizes)
    blocks = F.ceil(F.col("n") / LED)
    lead = shared.join(weight, "row").groupBy("band", "n").agg(F.max(F.struct("weight", (-F.col("row")).alias("minus"))).alias("top"))
    lead = scratch.saved(lead.select("band", "n", (-F.col("top.minus")).alias("leader")), "leaders")
    scratch.drop(weight)
    everywhere = lead.select("band", "leader", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    dealt = shared.select("band", "row", F.pmod(F.xxhash64("row"), blocks).alias("block"))
    led = dealt.join(everywhere, ["band", "block"]).where("row <> leader").select("row", "leader").distinct()
    tried = _verified(led, texts, scratch)
    scratch.drop(lead)
    roots = components(tried.where("linked").select("row", "leader"), scratch)
    return _completed(shared, tried, roots, texts, scratch)


def _completed(shared: DataFrame, tried: DataFrame, roots: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) once every two texts that may be linked across components are compared; drops all but the roots."""
    placed = shared.join(roots, shared["row"] == roots["node"], "left").select("band", "row", "kmers", F.coalesce("root", "row").alias("root"))
    placed = scratch.saved(placed, "placed")
    scratch.drop(shared)
    ends = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("kmers").alias("shortest")).where("low <> high")
    torn = placed.join(ends.select("band", "shortest"), "band").groupBy("row", "root", "kmers").agg(F.min("shortest").alias("shortest"))
    torn = scratch.saved(torn, "torn")
    scratch.drop(placed)
    open_rows = _open(torn, texts, scratch)
    scratch.drop(torn)
    pairs = _across(open_rows, texts, scratch)
    tested = tried.select(F.greatest("row", "leader").alias("row"), F.least("row", "leader").alias("leader"))
    untested = scratch.saved(pairs.join(tested, ["row", "leader"], "left_anti"), "untested")
    scratch.drop(pairs, tried)
    found = _verified(untested, texts, scratch)
    scratch.drop(untested, texts)
    found = found.where("linked").select("row", "leader")
    if found.isEmpty():
        return roots
    stars = roots.select(F.col("node").alias("row"), F.col("root").alias("leader"))
    return components(stars.unionByName(found), scratch)


def _open(torn: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, root, kmers, able): texts that may have a link to another component, with the k-mers that such a link may match."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            own = [kmers(np.frombuffer(x, np.uint32)).view(np.int64) for x in b.column(2).to_pylist()]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            rows, roots = (np.repeat(b.column(i).to_numpy(), sizes) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(roots), pa.array(np.concatenate(own))], ["row", "root", "kmer"])

    # not stored, as unpacking twice takes less than all k-mers on disk
    each = torn.join(texts, "row").select("row", "root", "words").mapInArrow(unpacked, "row long, root long, kmer long")
    shared = each.groupBy("kmer").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("kmer")
    able = each.select("row", "kmer").join(shared, "kmer", "left_semi").groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("able"))
    least_partner = F.greatest(F.col("shortest").cast("double"), 0.8 * F.col("kmers"))
    open_rows = torn.join(able, "row").where(9 * F.col("able") >= 4 * (F.col("kmers") + least_partner) - 1e-6)
    return scratch.saved(open_rows.select("row", "root", "kmers", "able"), "open")


def _across(open_rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, leader) with row > leader: open texts of different components in a common fine bucket.

    A bucket's texts outside its largest component meet all its texts, in blocks of ``BLOCK``.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            bands = pa.array([fine_sketches(kmers(np.frombuffer(x, np.uint32))) for x in b.column(4).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], bands], ["row", "root", "kmers", "able", "bands"])

    keys = open_rows.join(texts, "row").select("row", "root", "kmers", "able", "words").mapInArrow(keyed, "row long, root long, kmers int, able int, bands array<long>")
    fine = scratch.saved(keys, "fine")
    scratch.drop(open_rows)
    keys = fine.select("row", "root", "kmers", "able", F.explode("bands").alias("band"))
    sizes = keys.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    torn = sizes.groupBy("band").agg(F.max(F.struct("size", "root"))["root"].alias("home"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    torn = torn.select("band", "home", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    members = scratch.saved(keys.join(torn, "band").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))), "members")
    scratch.drop(fine)
    outer = members.where("root <> home").select(
        "band", *(F.col(c).alias(f"outer_{c}") for c in ("row", "root", "kmers", "able")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    )
    may_link = (F.col("root") != F.col("outer_root")) & (9 * F.least("able", "outer_able") >= 4 * (F.col("kmers") + F.col("outer_kmers")))
    once = (F.col("root") == F.col("home")) | (F.col("row") < F.col("outer_row"))
    both = outer.join(members, ["band", "block"]).where(may_link & once)
    pairs = scratch.saved(both.select(F.greatest("row", "outer_row").alias("row"), F.least("row", "outer_row").alias("leader")).distinct(), "pairs")
    scratch.drop(members)
    return pairs


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least node of each connected component, by alternating large and small stars up to their fixed point."""
    edges = scratch.saved(edges.select(F.greatest("row", "leader").alias("u"), F.least("row", "leader").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.saved(large, "stars")
        scratch.drop(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = scratch.saved(small.distinct(), "edges")
        scratch.drop(large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for every row of ``docs``, stored."""
    with Scratch(docs.sparkSession, "near") as scratch:
        base = _base(docs, scratch)
        groups = scratch.saved(base.where("copy is not null").groupBy("copy").agg(F.min("row").alias("text")), "copies")
        members = scratch.saved(base.select("row", "doc_id", "copy").join(groups, "copy", "left").select("row", "doc_id", F.coalesce("text", "row").alias("text")), "members")
        different = scratch.saved(groups.select(F.col("text").alias("row")), "different")
        scratch.drop(groups)
        roots = links(base, different, scratch)
        placed = members.join(roots, members["text"] == roots["node"], "left").select("row", "doc_id", F.coalesce("root", "text").alias("root"))
        placed = scratch.saved(placed, "placed")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        named = placed.groupBy("root").agg(first, F.count(F.lit(1)).alias("class_size"))
        named = scratch.saved(named, "named")
        many = F.broadcast(named.where(F.col("class_size") * 1000 > placed.count()))  # fewer than a thousand classes
        marked = placed.join(many, "root", "left")
        rest = marked.where("class_size is null").select("root", "row", "doc_id").join(named, "root")
        out = marked.where("class_size is not null").unionByName(rest)
        return saved(out.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept")), "classes")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; rows that share a doc_id stay or go together."""
    gone = classes(docs).groupBy("doc_id").agg(F.max("kept").alias("stays")).where("not stays and doc_id is not null").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
