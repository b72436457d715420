"""Cross-tokenizer alignment against the two libraries and plain counting."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from attestor.llm import alignment, queries

FOLDER = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in signs} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in signs)}
    bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def plain(text):
        """(n_a, n_b, groups, links) of a whole text."""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        own = [bytes_a[i] for i in ids_a], [piece(i) for i in ids_b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in own):
            return 0, 0, "", []
        at = []
        for tokens in own:
            n, ends = 0, {}
            for i, t in enumerate(tokens):
                n += len(t)
                ends[n] = i
            at.append(ends)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(at[0].keys() & at[1].keys()):
            x, y = at[0][end], at[1][end]
            groups.append(",".join(map(str, ids_a[i : x + 1])) + "|" + ",".join(map(str, ids_b[j : y + 1])))
            links.append((ids_a[x], ids_b[y]))
            i, j = x + 1, y + 1
        return len(ids_a), len(ids_b), ";".join(groups), links

    return plain


def expected(plain, texts):
    """One tuple for each text, in the order of the columns."""
    whole = [plain(t or "") for t in texts]
    counts = Counter(x for w in whole for x in w[3])
    best = [{}, {}]
    for ids, n in counts.items():
        for side in (0, 1):
            best[side][ids[side]] = max(n, best[side].get(ids[side], 0))
    return [
        (
            n_a, n_b, len(links), len(links), sum(counts[x] == best[1][x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(groups.encode()).hexdigest() if n_a else "", sum(counts[x] == best[0][x[0]] == best[1][x[1]] for x in links),
        )
        for n_a, n_b, groups, links in whole
    ]


def test_op13_equals_plain_counting(spark, libraries):
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    got = {r[0]: tuple(r)[1:] for r in queries.op13_alignment(spark, FOLDER).collect()}
    assert got == dict(zip(t["doc_id"], expected(libraries, t["text"]), strict=True))


def test_op13_odd_texts(spark, libraries, monkeypatch):
    """Special strings, white space of all kinds, other scripts, long words, nulls and repeated rows; both ways to join."""
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<s>", "<unk>", "<0x41>", "word", "Word", "ÉTÉ", "\r", "\r\n", ");\r", "\n", "\t", " ", "  ", "\xa0", " ", "　", "日本", "😀", "12,5", "'s", "é", "\x00", "\x1c", "\x85", "x" * 300, "​"]
    odd = [None, "", " ", "\n", "a ", "  a", "▁", "a ▁ b", "x" * 100_000, "word " * 20_000, "same", "same"]
    odd += ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 16))) for _ in range(1_500)]
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int, row string")
    want = Counter((r[0], *w) for r, w in zip(rows, expected(libraries, odd), strict=True))
    assert Counter(map(tuple, alignment.align(docs, *PATHS).collect())) == want
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert Counter(map(tuple, alignment.align(docs, *PATHS).collect())) == want
    assert alignment.align(docs.where("false"), *PATHS).count() == 0


def test_whole_texts_where_units_do_not_hold(libraries):
    p = alignment.Pair(*PATHS)
    p.by_unit = False
    for text in ("Hello world,\n  again ", "one  two\r\nthree", ""):
        n_a, n_b, groups, links = libraries(text)
        got = p.merge(text)
        assert got[:3] == (n_a, n_b, len(links)) and got[3] == (hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
