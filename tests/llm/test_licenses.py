"""License scans against a plain search of every template at every place."""

import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from attestor.llm import licenses, queries
from attestor.llm.license_texts import NOTICES, PHRASES, TEXTS

FOLDER = "/root/testdata/sf0.001"
ALL = [*NOTICES, *TEXTS]
SCHEMA = "doc_id long, text string, row string, at string, score string"


def words(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text):
    own = words(text)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def plain_labels(text):
    """Labels by a table of edit distances of each template over the whole text, overlaps settled as described."""
    own, found = words(text), []
    for label, template in ALL:
        t = words(template)
        edits = min(len(t) // 5, (len(t) - 3) // 3)
        if not set(t) & set(own):
            continue

        def best(a, b, t=t):
            column, top = [(i, a) for i in range(len(t) + 1)], (len(t) + 1, 0, 0)
            for j in range(a, b):
                last, column[0] = column[0], (0, j + 1)
                for i in range(1, len(t) + 1):
                    step = (last[0] + (t[i - 1] != own[j]), last[1])
                    last, column[i] = column[i], min(step, (column[i][0] + 1, column[i][1]), (column[i - 1][0] + 1, column[i - 1][1]), key=lambda x: x[0])
                if column[-1][0] < top[0]:
                    top = (column[-1][0], column[-1][1], j + 1)
            return top

        todo = [(0, len(own))]
        while todo:
            a, b = todo.pop()
            distance, start, end = best(a, b)
            if distance <= edits:
                found.append((1 - distance / len(t), start, end, label))
                todo += [(a, start), (end, b)]
    return found


def test_op12_equals_plain_search(spark):
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    got = {r["doc_id"]: r for r in queries.op12_licenses(spark, FOLDER).collect()}
    assert len(got) == len(t["doc_id"])
    for d, text in zip(t["doc_id"], t["text"], strict=True):
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        named = set(filter(None, r["base_labels"].split(",")))
        if len(text or "") < 3_000:
            found = plain_labels(text)
            assert set(filter(None, r["labels"].split(","))) - named <= {x[3] for x in found}
            assert r["score"] == pytest.approx(max((x[0] for x in found), default=0.5 if r["n_base"] else 0.0))
        if "CC BY-NC 4.0" in (text or ""):
            assert "cc-by-nc" in r["labels"].split(",") and "cc-by" not in r["labels"].split(",") and r["score"] == 1.0


def test_op12_finds_edited_templates(spark):
    """Each template with its budget of edits, amid other words, twice; both ways to join."""
    rng = random.Random(12)
    rows, want = [], {}
    for n, (label, template) in enumerate(ALL * 6):
        copies = []
        for _ in range(2):
            own = words(template)
            for _ in range(licenses.budget(len(own))):
                kind, at = rng.randrange(3), rng.randrange(len(own))
                own[at : at + (kind < 2)] = [] if kind == 0 else [f"zz{rng.randrange(10)}"]
            copies.append(" ".join(own))
        filler = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 30))) for _ in range(3)]
        rows.append((n, f"{filler[0]} {copies[0]}\n{filler[1]}, {copies[1]}. {filler[2]}", "r", "a", "s"))
        want[n] = label
    docs = spark.createDataFrame(rows, SCHEMA)
    first = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for n in want:
        own = plain_labels(rows[n][1])
        assert first[n]["score"] == pytest.approx(max(x[0] for x in own)) and first[n]["score"] >= 0.8
        stay = {x[3] for x in licenses.settled(own)} | set(filter(None, first[n]["base_labels"].split(",")))
        assert set(first[n]["labels"].split(",")) == stay


def test_op12_odd_texts(spark, monkeypatch):
    long = "Some words, then more. " * 30_000 + "Licensed under CC BY-SA 4.0."
    rows = [(1, None), (2, ""), (3, "!!! ,,"), (None, "Released under the MIT License."), (None, "Released under the MIT License."), (4, long), (5, "MİT License mit  LICENSE"), (6, "general public license " * 500)]
    docs = spark.createDataFrame([(d, t, *"abc") for d, t in rows], SCHEMA)
    got = licenses.scan(docs)
    out = Counter(map(tuple, got.collect()))
    assert sum(out.values()) == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    assert (by[1]["n_words"], by[1]["labels"], by[1]["score"], by[1]["first_word"]) == (0, "", 0.0, None) == (by[2]["n_words"], by[2]["labels"], by[2]["score"], by[2]["first_word"])
    assert (by[4]["labels"], by[4]["score"], by[4]["n_words"]) == ("cc-by-sa", 1.0, 120_007)
    assert (by[5]["n_base"], by[5]["labels"], by[5]["score"]) == (1, "mit", 0.5)
    assert (by[6]["n_base"], by[6]["first_word"], by[6]["last_word"]) == (500, 0, 1497)
    assert [n for r, n in out.items() if r[0] is None] == [2]
    monkeypatch.setattr(licenses, "BROADCAST_RUNS", 0)
    monkeypatch.setattr(licenses, "BROADCAST_SPANS", 0)
    assert Counter(map(tuple, licenses.scan(docs).collect())) == out
    assert licenses.scan(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="need"):
        licenses.scan(docs, [("x", "two words")])
