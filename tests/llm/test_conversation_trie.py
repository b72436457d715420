"""Conversation tries against a plain recursion over dictionaries."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest

from attestor.llm import conversation_trie, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, name string, pos string, round string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def turns_of(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(own)] for c, own in out.items()}


def regrown(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    """The rows of the trie, from a dictionary of prefixes."""
    members, chars = {}, {(): 0}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
            if d:
                chars[tuple(own[:d])] = len(own[d - 1][1])
    children, out = {}, {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        below = [out[x] for x in children.get(p, [])]
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out[p] = (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(x[5] for x in below) or 1,
            (len(members[p]) - 1) * chars[p] + sum(x[6] for x in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op11_equals_plain_recursion(spark):
    t = pq.read_table(f"{FOLDER}/conversations.parquet").to_pydict()
    rows = zip(t["conv_id"], t["turn"], t["role"], t["text"], strict=True)
    assert got(queries.op11_conversation_trie(spark, FOLDER)) == plain(regrown(turns_of(rows)))


@pytest.mark.parametrize("most", [1024, 4])
def test_op11_odd_conversations(spark, monkeypatch, most):
    """Nulls, ties, repeated rows, copies, long shared prefixes, prefixes of others, turnless ones, negative ids."""
    monkeypatch.setattr(conversation_trie, "MOST", most)
    monkeypatch.setattr(conversation_trie, "_EARLY", most.bit_length() - 1)
    monkeypatch.setattr(conversation_trie, "BLOCK_CHARS", 20)
    rng, rows = random.Random(11), []
    for c in [*range(40), *range(100, 130), 205, -7, -100, -101, 300]:
        n = rng.choice([1, 1, 2, 3, 5, 9, 20])
        turns = [(rng.choice([None, *range(4)]) if rng.random() < 0.2 else k, rng.choice(["user", "user", None]), rng.choice(["a", "b", "", None, "é😀"])) for k in range(n)]
        rows += [(c, *x) for x in turns] + ([(c, *turns[0])] if rng.random() < 0.2 else [])
    long = [(k, "user", f"turn {k}") for k in range(37)]
    for c in (400, 401, 402, 417, 433, 450, 451, 452):  # copies of a long one, and one that leaves it late
        rows += [(c, *x) for x in long] + ([(c, 99, "user", "more")] if c == 433 else [])
    rows += [(600 + k, 0, "user", "the same") for k in range(60)] + [(None, 0, "user", "nobody's"), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, "n", "p", "r") for r in rows], SCHEMA)
    convs = turns_of(rows)
    assert got(conversation_trie.of_regrown(docs)) == plain(regrown(convs))
    assert got(conversation_trie.of_conversations(docs)) == plain(convs)


def test_op11_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie.of_regrown(empty).count() == 0
    only = spark.createDataFrame([(c, 0, "user", "x", "", "", "") for c in (7, 8)], SCHEMA)  # both lose their only turn
    rows = got(conversation_trie.of_regrown(only))
    assert rows == plain(regrown(turns_of([(7, 0, "user", "x"), (8, 0, "user", "x")])))
