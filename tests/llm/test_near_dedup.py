"""Near-duplicate classes against all pairs compared in the plain way."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from attestor.llm import order_minhash, queries

FOLDER = "/root/testdata/sf0.01"


def labelled(text):
    w, seen, out = (text or "").lower().split(), Counter(), []
    for i in range(max(len(w) - 4, 1 if w else 0)):
        k = tuple(w[i : i + 5])
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute_classes(texts):
    """Least id of each component of texts whose aligned similarity is 0.8 or more."""
    kmers = {d: labelled(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, k in kmers.items():
        for x in k:
            holders[x].append(d)
    shared = Counter((a, b) for ds in holders.values() for i, a in enumerate(sorted(ds)) for b in sorted(ds)[i + 1 :])
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        total = len(kmers[a]) + len(kmers[b])
        if 9 * n >= 4 * total and find(a) != find(b) and 9 * longest(kmers[a], kmers[b]) >= 4 * total:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in texts}


def test_classes_equal_brute_force(spark):
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"], strict=True))
    expected = brute_classes(texts)
    got = {r["doc_id"]: r for r in queries.op9_near_dedup(spark, FOLDER).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == expected
    sizes = Counter(expected.values())
    assert len(sizes) < len(expected) - 20
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (d == r["class_id"]) for d, r in got.items())


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200))
    near = long.replace("w100 ", "x ")
    far = long.replace("w100 ", "x ").replace("w20 ", "y ").replace("w50 ", "z ").replace("w70 ", "q ").replace("w150 ", "p ")
    rows = [(1, long, "a"), (1, long, "b"), (2, near, "c"), (3, far, "d"), (4, "", "e"), (5, None, "f"), (6, "one two", "g"), (7, "One  two", "h"), (None, long, "i"), (8, "   ", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = order_minhash.classes(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert (by[1], by[2], by[4], by[5], by[6], by[7], by[8], by[None]) == (1, 1, 4, 5, 6, 6, 8, 1)
    assert sum(r["kept"] for r in got if r["class_id"] == 1) == 1
    kept = order_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) in ([0, 1, 1, 4, 5, 6, 8], [0, 1, 1, 3, 4, 5, 6, 8])
    assert order_minhash.classes(docs.where("false")).count() == 0


def test_family_with_edits_everywhere(spark):
    """Texts that miss their leaders meet all others of their buckets."""
    rng = random.Random(4)
    origin = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(80):
        w = list(origin)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        texts[d] = " ".join(w)
    expected = brute_classes(texts)
    got = order_minhash.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert all(r["class_id"] == expected[r["doc_id"]] for r in got)


def variants(seed, n, length):
    """An origin, ``n`` texts with one edit each and a second edit of each of these; all are linked in chains only."""
    rng = random.Random(seed)
    origin = [f"w{i}" for i in range(length)]
    texts = {0: " ".join(origin)}
    for i in range(n):
        w = list(origin)
        for k, name in enumerate("xy"):
            w[rng.randrange(length)] = f"{name}{i}"
            texts[2 * i + k + 1] = " ".join(w)
    return texts


def classes_of(spark, texts):
    got = order_minhash.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    return {r["doc_id"]: r["class_id"] for r in got}


def test_no_link_of_a_bucket_is_lost(spark):
    """Texts that miss their leaders meet all texts of their buckets, also those that linked to a leader."""
    texts = variants(2, 100, 60)
    assert classes_of(spark, texts) == brute_classes(texts)


def test_blocks_hold_every_pair(spark, monkeypatch):
    for name, value in {"LED": 8, "BLOCK": 4, "COARSE": 10}.items():
        monkeypatch.setattr(order_minhash, name, value)
    texts = variants(2, 50, 60) | {1000 + d: f"other {t}" for d, t in variants(3, 5, 30).items()}
    assert classes_of(spark, texts) == brute_classes(texts)


def test_families_that_fall_apart(spark):
    """Copies of copies: sub-families that share edits, chains between them and texts without any link."""
    rng = random.Random(11)
    origin = [f"w{i}" for i in range(150)]
    texts = {}
    for sub in range(6):
        base = list(origin)
        for k in range(sub):
            base[rng.randrange(150)] = f"s{sub}k{k}"
        for d in range(30):
            w = list(base)
            for k in range(rng.randint(0, 4)):
                w[rng.randrange(150)] = f"x{len(texts)}k{k}"
            texts[len(texts)] = " ".join(w)
    expected = brute_classes(texts)
    assert 5 < len(set(expected.values())) < 170
    assert classes_of(spark, texts) == expected


def test_fine_sketches_find_links():
    rng = np.random.default_rng(4)
    for n in (20, 31, 33, 40, 60, 99, 110, 400):
        missed = 0
        for _ in range(100):
            m = int(rng.integers(-(-8 * n // 10), n + 1))
            total = n + m
            common = -(-4 * total // 9)
            x = rng.integers(0, 2**63, total - common, dtype=np.uint64)
            own, other = np.split(x[common:], [n - common])
            a = np.insert(x[:common], np.sort(rng.integers(0, common + 1, n - common)), own)
            b = np.insert(x[:common], np.sort(rng.integers(0, common + 1, m - common)), other)
            assert order_minhash.linked(a, b)
            missed += not np.isin(order_minhash.fine_sketches(a), order_minhash.fine_sketches(b)).any()
        assert missed <= 3, n


def test_short_texts_share_a_bucket():
    """Every linked pair of up to ten k-mers, and nearly every pair at or above 0.8 beyond."""
    rng = np.random.default_rng(3)
    for n in range(1, 25):
        for m in range(n, 25):
            for common in range(-(-4 * (n + m) // 9), n + 1):
                missed = 0
                for _ in range(20):
                    x = rng.integers(0, 2**63, n + m - common, dtype=np.uint64)
                    own, other = np.split(x[common:], [n - common])
                    a = np.insert(x[:common], rng.integers(0, common + 1, n - common), own)
                    b = np.insert(x[:common], rng.integers(0, common + 1, m - common), other)
                    assert order_minhash.linked(a, b)
                    missed += not np.isin(order_minhash.sketches(a), order_minhash.sketches(b)).any()
                assert missed <= (0 if m <= 10 else 1)


def test_one_word_more_or_less(spark):
    """Pairs of 8 and 9, 9 and 10, and 13 and 13 words with one word appended or changed at an end."""
    texts = {}
    for f in range(30):
        for size, more in ((8, 1), (9, 1), (13, 0)):
            w = [f"f{f}s{size}w{i}" for i in range(size)]
            texts[len(texts)] = " ".join(w)
            texts[len(texts)] = " ".join([*w, "more"] if more else [*w[:-1], "more"])
            texts[len(texts)] = " ".join(w[: size // 2])  # no link
    expected = brute_classes(texts)
    assert len(set(expected.values())) == 180
    assert classes_of(spark, texts) == expected
