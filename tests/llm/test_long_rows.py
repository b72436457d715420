"""Very long rows and clashing columns for operators that had neither tested."""

import hashlib
import random
import re

from attestor.llm import conversation_trie, licenses, order_minhash, secrets, warc


def test_warc_of_large_pages_with_other_columns(spark):
    big = "<p>" + "é日 plain " * 500_000 + "</p>"
    rows = [(2, "u", big, "x", 1, "y"), (1, None, big, "x", 1, "y"), (3, "u\r\nv", "short", None, None, None), (None, "u", big, "x", 1, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to int, salt__ string")
    got = {r["page_id"]: r for r in warc.read(warc.write(pages)).collect()}
    digest = hashlib.sha256(big.encode()).hexdigest()
    assert {k: (r["record_type"], r["refers_to"], r["payload_digest"] == digest, r["payload_bytes"]) for k, r in got.items()} == {
        1: ("response", None, True, len(big.encode())), 2: ("revisit", 1, True, len(big.encode())), None: ("revisit", 1, True, len(big.encode())), 3: ("response", None, False, 5),
    }
    assert bytes(got[1]["payload"]).decode() == big and got[2]["payload"] is None


def test_near_copies_of_twenty_thousand_words(spark):
    rng = random.Random(18)
    words = [f"w{rng.randrange(5_000)}" for _ in range(20_000)]
    edited = words.copy()
    for at in rng.sample(range(20_000), 300):
        edited[at] = "edited"
    other = [f"w{rng.randrange(5_000)}" for _ in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(w), "r", 1) for i, w in ((4, words), (9, edited), (5, other), (7, [*words[:50], *other]))], "doc_id long, text string, root string, row int")
    assert {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs).collect()} == {4: 4, 9: 4, 5: 5, 7: 5}


def test_secrets_of_a_text_with_thousands(spark):
    rng = random.Random(19)
    letters = "abcdef0123456789"
    parts = []
    for i in range(4_000):
        parts.append(rng.choice([f"password = 'p{i}x{rng.randrange(10**6)}'", f"AKIA{''.join(rng.choice('ABCDEFGH234567') for _ in range(16))}", "".join(rng.choice(letters) for _ in range(30)), "日本 😀 word", "token:abc"]))
    text = "\n".join(parts)
    want = []
    base = [
        re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"),
    ]
    for kind, (pattern, least) in enumerate(zip(base, (6, 20, 24), strict=True)):
        want += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[2] if kind == 0 else m[0]) >= least]
    names = ("assign", "access", "hex")
    listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(want))
    docs = spark.createDataFrame([(1, text, "s", "h"), (2, None, "s", "h")], "doc_id long, text string, source string, hash string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    assert len(want) > 2_000 and got[1]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_licenses_repeated_thousands_of_times(spark):
    text = "Licensed under CC BY-SA 4.0. " * 3_000
    r = licenses.scan(spark.createDataFrame([(1, text, "h")], "doc_id long, text string, hits string")).first()
    assert (r["labels"], r["score"], r["spans"].count(",")) == ("cc-by-sa", 1.0, 2_999)


def test_one_conversation_with_most_of_the_turns(spark):
    rows = [(1, k, "user", f"t{k % 7}") for k in range(3_000)] + [(2, k, "user", f"t{k % 7}") for k in range(2_500)] + [(c, 0, "user", "t0") for c in range(3, 40)]
    nodes = {(r["conv_id"], r["depth"]): r for r in conversation_trie.of_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(nodes) == 3_001 and nodes[1, 2_500]["n_convs"] == 2 and nodes[1, 1]["n_convs"] == 39 and nodes[1, 2_501]["n_convs"] == 1
    assert nodes[1, 0]["n_leaves"] == 1 and nodes[1, 0]["saved_tokens"] == 2 * (38 + 2_499) and nodes[1, 3_000]["n_children"] == 0
