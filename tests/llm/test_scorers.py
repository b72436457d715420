"""The queries of the classifiers against a plain scorer: features counted word by word, trees walked node by node."""

import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from attestor.llm import quality, queries, toxicity
from attestor.llm.labelled import remainder, sample

FOLDER = "/root/testdata/sf0.001"
MARKS, SYMBOL_ENDS = set("!\"'(),-.:;?"), set("!*#$%&@^~|<>=+\\/_")


def walked(forest, x):
    margin = forest.bias
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        margin += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-margin))


def plain_statistics(text):
    if not text:
        return [0.0] * 26
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n, size = max(len(words), 1), len(raw)
    known, of = Counter(words), lambda test: sum(test(chr(b)) for b in raw if b < 128)
    run = longest = 1 if words else 0
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    upper, lower, digits, marks = (of(t) for t in (str.isupper, str.islower, str.isdigit, MARKS.__contains__))
    shares = [c / size for c in Counter(raw).values()]
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(len(w) for w in words) / n, len(known) / n, max(known.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(zip(words, words[1:], strict=False))) / n, upper / size, lower / size, digits / size, raw.count(b" ") / size, raw.count(b"\n") / size, marks / size,
        (of(lambda c: "!" <= c <= "~") - marks - upper - lower - digits) / size, sum(b >= 128 for b in raw) / size, -sum(p * math.log2(p) for p in shares), sum(w.isupper() for w in words) / n,
        sum(not w[-1].isalnum() for w in words) / n, sum(w[-1] in SYMBOL_ENDS for w in words) / n, sum(c for w, c in known.items() if len(w) == 1 and not w.isalnum()) / n, math.log1p(len(lines)), len(text) / len(lines),
        len(set(lines)) / len(lines), max((len(w) for w in words), default=0), sum(w[-1] == "." for w in words) / n, longest / n,
    ]


def plain_features(text, lexicon):
    if not text:
        return [0.0] * 20
    words = [w for w in (w.strip(toxicity.EDGE) for w in text.lower().split()) if w]
    n, raw = max(len(words), 1), text.split()
    leet = dict(zip("013457@$!", "oieastasi", strict=True))
    hits, kinds = set(), [0, 0, 0, 0]
    odd = 0
    for i, w in enumerate(words):
        plain = "".join(c for c in (leet.get(c, c) for c in w) if c.isalpha())
        odd += not w.isalpha()
        is_kind = (
            w in lexicon.words, w in lexicon.learned, any(w[:k] in lexicon.stems for k in (4, 5, 6)),
            not w.isalpha() and plain != w and (plain in lexicon.words or plain in lexicon.learned),
        )
        kinds = [a + b for a, b in zip(kinds, is_kind, strict=True)]
        if any(is_kind):
            hits.add(i)
    near = sum(any(w in toxicity.SECOND_PERSON for w in words[max(0, i - 6) : i + 7]) for i in hits)
    of = lambda test: sum(test(c) for c in text if c.isascii())
    upper, lower, digits, marks = (of(t) for t in (str.isupper, str.islower, str.isdigit, MARKS.__contains__))
    symbols = of(lambda c: "!" <= c <= "~") - upper - lower - digits - marks
    return [
        *(x for k in kinds for x in (k, k / n)), odd / n, near, near / n, sum(w.isupper() for w in raw) / n, upper / len(text), text.count("!") / n, marks / n, symbols / n, digits / n,
        len(words), sum(len(w) for w in words) / n, len(set(words)) / n,
    ]


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def trained(spark, module, label, keep):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return module.fit(sample(docs, labels, label, keep, 16_000))


def single(x):
    """Features as the models see them, in single precision."""
    return np.array(x, np.float32).astype(float)


def test_op8_equals_a_plain_scorer(spark, texts):
    forest = trained(spark, quality, "quality", remainder("doc_id", 5) != 0)
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        want = walked(forest, single(plain_statistics(text)))
        assert got[d]["score"] == pytest.approx(want, abs=1e-9) and got[d]["predicted"] == int(got[d]["score"] >= 0.3), d


def test_op3_equals_a_plain_scorer(spark, texts):
    model = trained(spark, toxicity, "toxic", remainder("doc_id", 3) != 1)
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    xs, ys = model.knots
    for d, text in texts.items():
        p = walked(model.forest, single(plain_features(text, model.lexicon)))
        i = int(np.searchsorted(xs, p, side="right")) - 1
        want = ys[0] if i < 0 else ys[-1] if i >= len(xs) - 1 else ys[i] + (ys[i + 1] - ys[i]) * ((p - xs[i]) / (xs[i + 1] - xs[i]))
        assert got[d]["score"] == pytest.approx(want, abs=1e-9) and got[d]["predicted"] == int(got[d]["score"] >= 0.7), d


def test_repeated_rows_score_alike(spark):
    docs = spark.createDataFrame([(1, "some Words of 2!"), (2, "some Words of 2!"), (1, "some Words of 2!"), (3, None), (4, ""), (None, None)], "doc_id long, text string")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    corpus = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    forest, model = quality.fit(sample(corpus, labels, "quality", F.lit(True), 16_000)), toxicity.fit(sample(corpus, labels, "toxic", F.lit(True), 16_000))
    for rows in (quality.score(docs, forest), toxicity.score(docs, model)):
        got = sorted((r["doc_id"] if r["doc_id"] is not None else 9, r["score"]) for r in rows.collect())
        assert len(got) == 6 and len({s for d, s in got if d in (1, 2)}) == 1 and len({s for d, s in got if d in (3, 4, 9)}) == 1
