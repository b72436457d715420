"""Whole queries on the small tables against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from attestor.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], (x or "" for x in t["text"]), strict=True))


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_op1_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = rows(queries.op1_token_files(spark, FOLDER)), 0
    assert len(got) == len(texts)
    for d in sorted(texts):
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op1_odd_texts(spark):
    """Special strings, marks, white space and other scripts against the plain library, also as files read back."""
    import random

    from tokenizers import Tokenizer

    from attestor.llm import token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    rng, library = random.Random(8), Tokenizer.from_file(path)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|END", "word", "Word", "ÉTÉ", "İst", "ſ", "naïve", "日本", "😀", "12,5", "'s", "!!", "\n", "\t", "\r\n", " ", "  ", "\xa0", "\u2028", "-", "|", "x" * 300]
    odd = ["", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> ", "x" * 200_000]
    odd += ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 20))) for _ in range(3_000)]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for as_text in (False, True):
        library.encode_special_tokens = as_text
        got, start = rows(token_files.read(token_files.write(docs, path, special_as_text=as_text))), 0
        for d, text in enumerate(odd):
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
            assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), text[:60]
            start += len(ids)


def test_op5_equals_the_library(spark, texts):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(queries.op5_byte_bpe(spark, FOLDER))
    assert len(got) == len(texts)
    for d, text in texts.items():
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op5_odd_texts(spark):
    """Long unbroken matches, pathological runs and random bytes against the library."""
    import random
    import unicodedata

    import tiktoken

    from attestor.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = bpe.encoder(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(6)
    odd = ["a" * 20_000, "ab" * 9_000, "é" * 5_000, " " * 3_000 + "x", "\n\t  \r\n" * 500, "日本語" * 3_000, "0123456789" * 1_000, "", "'s 's'll  I'd"]
    odd += ["".join(rng.choice("abc dé\n1.,'日😀ß") for _ in range(rng.randrange(1, 60))) for _ in range(2_000)]
    assigned = [c for c in map(chr, range(32, 0xD7FF)) if unicodedata.category(c) != "Cn"]  # both libraries know their classes
    odd += ["".join(rng.choice(assigned) for _ in range(40)) for _ in range(500)]
    docs = spark.createDataFrame([*enumerate(odd), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    for d, text in [*enumerate(odd), (None, "")]:
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest()), text[:40]
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_memory_is_bounded():
    from attestor.llm.memory import Remembered

    made = []
    known = Remembered(lambda k: made.append(k) or "x" * 50, 40_000)
    for i in range(5_000):
        assert known[i] == "x" * 50 and known[0] == "x" * 50
    assert len(known) + len(known.old) < 400 and made.count(0) < 50
    known["long" * 10_000]
    assert "long" * 10_000 not in known


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def all_spans(texts, owners, most=20):
    """Base spans and, of the long mixed tokens apart from them, those of one owner and few documents."""
    found, held = {}, {}
    for d, text in texts.items():
        base = base_spans(text)
        mixed = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]{28,}", text)]
        mixed = [m for m in mixed if re.search("[0-9]", m[3]) and re.search("[A-Za-z]", m[3]) and not any(b[0] < m[2] and m[0] < b[2] for b in base)]
        found[d] = base, mixed
        for x in base + mixed:
            held.setdefault(x[3], set()).add((owners[d], d))
    live = {v for v, at in held.items() if len({o for o, _ in at}) == 1 and len({d for _, d in at}) <= most}
    return {d: sorted(base + [m for m in mixed if m[3] in live]) for d, (base, mixed) in found.items()}


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'live')[k]}:{s}:{e}" for s, k, e, _ in spans)


def test_op10_base_spans(spark, texts):
    got = rows(queries.op10_secrets(spark, FOLDER))
    assert len(got) == len(texts)
    for d, text in texts.items():
        base = base_spans(text)
        assert got[d]["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [got[d][f"n_{n}"] for n in ("assign", "access", "hex")] == [sum(k == i for _, k, _, _ in base) for i in range(3)]
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    expected = all_spans(texts, dict(zip(t["doc_id"], t["source"], strict=True)))
    assert {d: r["spans"] for d, r in got.items()} == {d: listed(x) for d, x in expected.items()}


def test_op10_owners_and_repositories(spark):
    """A value of one owner is live up to 20 repositories; texts with many matches keep all their spans."""
    import random

    from attestor.llm import secrets

    rng = random.Random(2)
    token = lambda: "".join(rng.choice("abcXYZ019_-") for _ in range(30)) + "aZ9"
    few, many, two = token(), token(), token()
    texts = {d: f"x {few}" for d in range(20)} | {100 + d: f"é {many} y" for d in range(21)} | {200: two, 201: two}
    texts[300] = " ".join(rng.choice([token(), "ab" * 12, "secret=abcdef", "AKIA" + "A1" * 10, "token: zz"]) for _ in range(3_000))
    owners = dict.fromkeys(texts, "one") | {201: "other"}
    docs = spark.createDataFrame([(d, t, owners[d]) for d, t in texts.items()], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    expected = {d: listed(x) for d, x in all_spans(texts, owners).items()}
    assert got == expected and got[0] and not got[100] and not got[200] and got[300].count("live") > 400
