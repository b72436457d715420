"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from attestor.llm import bpe, cuckoo, decontaminate, exact_dedup, line_dedup, quality, secrets, token_files, toxicity, warc

LONG = "a fairly ordinary sentence about nothing much. " * 4000
ROWS = [(3, "Same  text here\nand more"), (1, "Same text here and more"), (1, "Same text here and more"), (2, None), (4, ""), (None, "Same text\there and more"), (5, LONG), (6, "a\n\n  b  \r\n"), (7, "日本語 ñ é 😀")]
EXTRA = "doc_id long, text string, digest string, row string, drop string, n_lines string, score string, source string, band string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *"abcdefgh") for d, t in ROWS], EXTRA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, None, None), (None, 1, 1), (1, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")


def test_exact_dedup(docs):
    got = exact_dedup.deduplicate(docs).collect()
    assert len(got) == len(ROWS)
    same = [r for r in got if r["group_size"] == 4]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in same} == {(3, 1, False), (1, 1, True), (None, 1, False)} and len(same) == 4
    empty = [r for r in got if r["group_size"] == 2]
    assert {(r["doc_id"], r["kept"]) for r in empty} == {(2, True), (4, False)}
    assert empty[0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.deduplicate(docs.where("false")).count() == 0


def test_exact_dedup_splits_equal_digests(spark, docs, monkeypatch):
    """With digests that always clash, bytes decide."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.deduplicate(rows).collect()}
    assert got == {(1, 1, 2), (2, 2, 1), (3, 1, 2)}


def test_exact_index_takes_batches(spark):
    """Each batch is answered for its own rows, against all batches so far, while levels are compacted."""
    index, texts, n = exact_dedup.ExactIndex(spark), {}, 0
    for batch in range(exact_dedup.FAN + 2):
        rows = [(100 - n - i, f"text  {(n + 3 * i) % 11}" if i % 3 else f"only {n} {i}") for i in range(8)] + [(None, "text 1"), (500 + batch, None)]
        n += 8
        for d, t in rows:
            texts.setdefault(" ".join((t or "").split(" ")).replace("  ", " "), []).append(d)
        got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), index).collect()
        assert len(got) == len(rows)
        by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in texts.items()}
        for r in got:
            ids = by[r["text_sha256"]]
            assert (r["keep_id"], r["group_size"]) == (min((d for d in ids if d is not None), default=None), len(ids))
        assert {r["doc_id"] for r in got} == {d for d, _ in rows}
    assert exact_dedup.MEMTABLES * (exact_dedup.FAN + 2) == 30  # 132 in base 4
    assert [(r.level, r.last - r.first + 1) for r in index.runs] == [(2, 16), (1, 4), (1, 4), (1, 4), (0, 1), (0, 1)]


def test_exact_dedup_of_one_table_goes_through_runs_and_filters(spark, monkeypatch):
    """The registered query's way: memtables, probes of older runs' filters, a compacted level, answers from the runs."""
    made, wanted = [], {}
    init = exact_dedup.ExactIndex.__init__
    monkeypatch.setattr(exact_dedup.ExactIndex, "__init__", lambda self, *a, **k: (init(self, *a, **k), made.append(self))[0])
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    for i, t in rows:
        wanted.setdefault(t, []).append(i)
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, min(wanted[t]), len(wanted[t])) for i, t in rows}
    (index,) = made
    assert [r.level for r in index.runs] == [1, 0] and sum(r.keys for r in index.runs) >= 700
    assert index.probes == 0 + 1 + 2 + 3 + 1 + 2  # each memtable the runs before it, then the hits both runs
    folders = {p.name for p in __import__("pathlib").Path(index.root.removeprefix("file://").removeprefix("file:")).iterdir()}
    assert {"memtables-0", "run-1-0-3", "run-1-0-3-filter", "run-0-4-4", "run-0-4-4-filter", "hits-0", "groups-1", "answers-1"} <= folders


def test_exact_index_filters(spark):
    index = exact_dedup.ExactIndex(spark)
    make = lambda a, b: spark.createDataFrame([(i, f"text {i}") for i in range(a, b)], "doc_id long, text string")
    exact_dedup.deduplicate(make(0, 3000), index)
    digests = lambda a, b: make(a, b).select(F.unhex(F.sha2("text", 256)).alias("digest"))
    assert len(index.runs) == 2 and sum(r.keys for r in index.runs) == 3000
    passing = [index.passing(digests(0, 3000), r).distinct() for r in index.runs]
    assert passing[0].union(passing[1]).distinct().count() == 3000
    for r in index.runs:
        assert index.passing(index.rows(r).select("digest"), r).count() == r.keys
        assert index.passing(digests(3000, 6000), r).count() < 400


def test_exact_index_verifies_older_bytes(spark, monkeypatch):
    """With digests that always clash, the texts of older batches are read back and decide."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    index = exact_dedup.ExactIndex(spark)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.deduplicate(make([(1, "a"), (2, "b"), (3, "a")]), index).collect()
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.deduplicate(make([(0, "b"), (9, "a"), (8, "c")]), index).collect()}
    assert got == {(0, 0, 2), (9, 1, 3), (8, 8, 1)}


def test_line_dedup(spark, docs):
    got = line_dedup.deduplicate_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert (by[2]["text"], by[2]["n_lines"], by[4]["n_lines"]) == ("", 1, 1)
    assert by[6]["text"] == "a\n\n  b  \r\n" and by[6]["n_lines"] == 4 and by[7]["text"] == ROWS[-1][1]
    assert by[5]["text"] == LONG and by[1]["n_dropped"] == 0
    assert line_dedup.deduplicate_lines(docs.where("false")).count() == 0
    lines = spark.createDataFrame([(None, "The very first line"), (9, " the VERY first line\t\nshort\nshort"), (8, "the very first line\nother line of words"), (8, "the very first line\nother line of words")], "doc_id long, text string")
    cut = {(r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.deduplicate_lines(lines).collect()}
    assert cut == {(None, "", 1), (9, "short\nshort", 1), (8, "the very first line\nother line of words", 0)}


def test_line_index_is_reversible(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    a, b, c = make([(1, "line number one\nline number two")]), make([(2, "line number two\nline number three")]), make([(3, "line number three\nline number one")])
    index = line_dedup.LineIndex(spark, shards=4)
    index.insert(a), index.insert(b), index.insert(c)
    refs = lambda: {(bytes(r["digest"]), r["first_doc"], r["refs"]) for r in index.references.collect()}
    assert len(refs()) == 3
    index.delete(a)
    assert {(x[1], x[2]) for x in refs()} == {(2, 2)}
    fresh = line_dedup.LineIndex(spark, shards=4)
    fresh.insert(b.unionByName(c))
    assert refs() == {(bytes(r["digest"]), r["first_doc"], r["refs"]) for r in fresh.references.collect()}
    held = {s: line_dedup._load(index.filters[s]) if s in index.filters else None for s in range(4)}
    digests = [r["digest"] for r in line_dedup.postings(a).withColumn("s", line_dedup._shard(4)).where("digest is not null").collect()]
    shard = {bytes(r["digest"]): r["s"] for r in line_dedup.postings(a.unionByName(b)).withColumn("s", line_dedup._shard(4)).collect()}
    for d in digests:  # line one was unshared by the deletion, and the filter says so
        f = held[shard[bytes(d)]]
        assert f is None or not f.contains(line_dedup._hash64([bytes(d)]))[0]
    assert {(r["doc"], len(r["drop"])) for r in index.probe(None).collect()} == {(3, 1)}


def test_line_index_counts_documents(spark):
    """A document counts once, however often it is given; the smallest one is repaired when it goes."""
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    line, other = "one line that is shared", "another line that is shared"
    index = line_dedup.LineIndex(spark, shards=2, parts=4)
    index.insert(make((1, line), (1, line), (2, line)))
    refs = lambda: sorted((r["first_doc"], r["refs"]) for r in index.references.collect())
    assert refs() == [(1, 2)]
    index.insert(make((1, line), (1, f"{line}\n{other}"), (3, line)))
    assert refs() == [(1, 3)]
    index.insert(make((4, other)))
    assert refs() == [(1, 2), (1, 3)]
    index.delete(make((1, None), (77, None)))
    assert refs() == [(2, 2)]
    index.delete(make((1, None)))
    index.insert(make((0, line)))
    assert refs() == [(0, 3)] and {(r["doc"], len(r["drop"])) for r in index.probe(None).collect()} == {(2, 1), (3, 1)}
    assert {r["doc"] for r in index.probe(make((9, f" {line.upper()}"), (8, other))).collect()} == {9}


def test_line_index_reads_touched_partitions_only(spark):
    make = lambda a, b: spark.createDataFrame([(d, f"line of the number {d // 2}") for d in range(a, b)], "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=8, parts=64)
    index.insert(make(0, 400))
    before = dict(index.filters)
    one = spark.createDataFrame([(900, "line of the number 7"), (901, "a line that is new here")], "doc_id long, text string")
    delta = line_dedup.postings(one).groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    plan = index._touched(delta)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[part#\d+ IN \(\d+,\d+\)", plan) or re.search(r"PartitionFilters: \[.*\(part#\d+ = \d+\)", plan)  # two of 64
    index.insert(one)
    assert len(index.log) == 2 and spark.read.parquet(index.log[1]).count() == 2 and spark.read.parquet(index.versions[1]).count() == 2
    assert index.filters == before  # no key has become shared
    for n in range(line_dedup.VERSIONS):
        index.insert(spark.createDataFrame([(1000 + n, "line of the number 7")], "doc_id long, text string"))
    assert len(index.versions) <= line_dedup.VERSIONS and {r["refs"] for r in index.references.collect()} == {2, 3 + line_dedup.VERSIONS}


def test_line_filters_grow_with_their_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10)
    make = lambda first, last: spark.createDataFrame([(d, "\n".join(f"common line number {i}" for i in range(first, last))) for d in (2 * first, 2 * first + 1)], "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=1)
    for first, last, shards in ((0, 8, 1), (8, 9, 1), (20, 60, 8)):
        index.insert(make(first, last))
        assert index.shards == shards
    one = make(70, 71)
    index.insert(one)
    dropped = lambda: {r["doc"]: len(r["drop"]) for r in index.probe(None).collect()}
    assert dropped() == {1: 8, 17: 1, 41: 40, 141: 1} and index.references.count() == 50
    index.delete(one)
    assert dropped() == {1: 8, 17: 1, 41: 40} and index.references.count() == 49


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    f = cuckoo.build(h)
    assert f.contains(h).all()
    assert f.contains(rng.integers(0, 2**63, 50_000, dtype=np.uint64)).mean() < 0.001
    f.delete(h[:1000])
    assert f.contains(h[1000:]).all() and f.contains(h[:1000]).mean() < 0.01
    assert cuckoo.CuckooFilter.from_bytes(f.to_bytes()).contains(h[1000:]).all()
    assert not cuckoo.build(h[:0]).contains(h[:5]).any()


def test_secrets(spark, docs):
    found = secrets.digest(secrets.find_secrets(docs)).collect()
    assert len(found) == len(ROWS) and all(r["spans"] == "" for r in found)
    texts = [
        (1, 'é password = "abcdef" token:abc', "x"), (2, "AKIA" + "Z" * 16 + " AKIAX", "x"), (3, "f" * 24 + " " + "0" * 23, None), (4, None, "y"),
        (5, "key zzzZZZ0000zzzZZZ0000zzzZZZ0000 here", "x"), (6, "key common0000common0000common0000 here", "x"), (7, "key common0000common0000common0000 here", "y"),
    ]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string, source string"))).collect()}
    assert got[1]["spans"] == "assign:2:20" and got[2]["spans"] == "access:0:20" and got[3]["spans"] == "hex:0:24" and got[4]["spans"] == ""
    assert got[5]["spans"] == "live:4:34" and got[6]["spans"] == "" and got[6]["n_shared"] == 1 and got[5]["n_live"] == 1
    assert secrets.digest(secrets.find_secrets(docs.where("false"))).count() == 0


def test_warc(spark):
    page = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1</p>"
    rows = [(1, "http://a/\r\nb", None), (2, None, "tiny"), (3, "u", "tiny"), (9, "u", page), (4, "u", page), (4, "u", page), (None, "u", page), (5, "u", page + "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages)
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == len(page))
    assert kinds == [(0, "revisit", 4), (4, "response", None), (4, "response", None), (9, "revisit", 4)]
    by = {r["page_id"]: r for r in got}
    assert bytes(by[5]["payload"]).decode() == page + "é" and by[1]["payload_bytes"] == 0 and by[2]["record_type"] == by[3]["record_type"] == "response"
    assert by[9]["payload_digest"] == hashlib.sha256(page.encode()).hexdigest() and by[9]["payload"] is None
    some = warc.read(index.where("page_id in (2, 5)")).collect()
    assert sorted(r["page_id"] for r in some) == [2, 5]
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_token_files(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    shards = token_files.write(docs, path, shards=3)
    got = token_files.read(shards).collect()
    assert len(got) == len(ROWS)
    ends = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False)) and ends[0][2] is None
    assert [d for _, _, d in ends[1:]] == sorted(d for d, _ in ROWS if d is not None)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 4)} == {1}
    where, _, width = token_files.based(shards)[0]
    shard = token_files.Shard(where, width)
    assert int(shard[len(shard) - 1][-1]) == 1 and isinstance(shard.ids, np.memmap)
    assert token_files.read(token_files.write(docs.where("false"), path)).count() == 0


def test_bpe(spark, docs):
    got = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(got) == len(ROWS)
    for r in got:
        texts = {hashlib.sha256((t or "").encode()).hexdigest() for d, t in ROWS if d == r["doc_id"]}
        assert r["decoded_sha256"] in texts
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 4)} == {0}
    assert bpe.encode(docs.where("false"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_bpe_equals_the_library_on_odd_texts():
    import random

    import tiktoken

    e = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(7)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "日", "0", "12", "'s", "'", "'re", "!", "…", " ", "\x1c", "　", "😀", "́", "\r\n", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500 + "x", "é" * 1000, "".join(rng.choice("abcdeth") for _ in range(5000))]
    for t in texts:
        ids = np.frombuffer(e.encode(t), "<u4")
        assert ids.tolist() == library.encode_ordinary(t) and e.decode(ids) == t.encode()


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(text):
            last, row[j + 1] = row[j + 1], min(last + (c != d), row[j] + 1, row[j + 1] + 1)
    return min(row)


def test_decontamination(spark, docs):
    import random

    rng, items = random.Random(3), []
    for i in range(5):
        items.append((i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(25))))
    texts, near = [], {}
    for n in range(60):
        item, edits = items[n % 5][1], n % 15
        chars = list(item)
        for _ in range(edits):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["z"], [chars[at], "q"]])
        texts.append((n, f"Some words BEFORE  {''.join(chars).upper()}\nand after"))
        for i, item in items:
            d = edit_distance(item, decontaminate.normal(texts[-1][1]))
            if d <= decontaminate.budget(len(item), 0.08):
                near[n, i] = d
    benchmark = spark.createDataFrame([*items, (8, None), (9, ""), (10, "short"), (None, "and this one has no identifier at all but a text")], "item_id long, text string")
    found = decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in found} == near and 10 < len(near) < 60
    assert decontaminate.matches(docs, benchmark).count() == 0
    kept = decontaminate.without_matches(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert decontaminate.matches(docs, benchmark.where("false")).count() == 0


def test_blocks_of_a_large_benchmark_find_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"number {i} of the benchmark items that are searched") for i in range(6)], "item_id long, text string")
    texts = spark.createDataFrame([(1, "x number 3 of the benchmark items that are searched y"), (2, "nothing")], "doc_id long, text string")
    whole = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(texts, items, least=10).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(texts, items, least=10).collect()) == whole and (1, 3, 0) in whole


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(docs, labels, module):
    scored = module.train_and_score(docs, labels).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    nothing = module.train_and_score(docs, labels.where("false")).collect()
    assert all(r["score"] < 1e-6 for r in nothing)
    assert module.train_and_score(docs.where("false"), labels).count() == 0


def test_toxic_rows_go_with_all_columns(docs, labels):
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
