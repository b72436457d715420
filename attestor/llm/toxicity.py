"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of lexicon words, how near they stand to second-person pronouns, shares of capitals
and punctuation, and rates of obfuscated spellings.  The lexicon has a fixed seed of English insults; words and word
beginnings of any language are added that the training labels mark beyond chance in several unrelated documents.

Defined results: null and empty texts are scored like any other (all features 0); a table without usable labels gives
0 to every document; repeated rows are scored one by one; rows keep their number and order is free.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import boosting
from attestor.llm.labelled import sample

# The seed lexicon and the second-person pronouns of the four languages of the corpus.
SEED = frozenset("idiot moron loser scum trash clown worthless pathetic disgusting stupid".split())
SECOND_PERSON = frozenset("you your yours yourself u tu te toi vous votre vos du dich dir dein deine ihr euch sie ihnen usted ustedes tú ti vosotros su sus".split())
LEET = str.maketrans("013457@$!", "oieastasi")
EDGE = ".,;:!?\"'`´()[]{}<>*#$%&|+-_/\\=~^@…«»“”‘’¡¿"
STEMS = (4, 5, 6)
NEAR = 6
COLUMNS = (
    "seed_hits seed_density word_hits word_density stem_hits stem_density obfuscated_hits obfuscated_density odd_rate near_hits near_density"
    " capital_words capital_letters exclamations punctuation symbols digits words mean_word distinct"
).split()


@dataclass
class Lexicon:
    """Whole words and word beginnings."""

    words: frozenset = SEED
    learned: frozenset = frozenset()
    stems: frozenset = frozenset()


@dataclass
class Model:
    lexicon: Lexicon = field(default_factory=Lexicon)
    forest: boosting.Forest = field(default_factory=lambda: boosting.fit(np.zeros((0, len(COLUMNS))), np.zeros(0)))
    knots: tuple = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.forest.probability(x), *self.knots)


def bare_words(text: str) -> list[str]:
    """Lower-case words without the marks around them."""
    return [w for w in (w.strip(EDGE) for w in text.lower().split()) if w]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, in the order of ``COLUMNS``."""
    if not text:
        return [0.0] * len(COLUMNS)
    words = bare_words(text)
    n, chars = max(len(words), 1), len(text)
    seed = [i for i, w in enumerate(words) if w in lexicon.words]
    learned = [i for i, w in enumerate(words) if w in lexicon.learned] if lexicon.learned else []
    stems: set[int] = set()
    for k in STEMS if lexicon.stems else ():
        stems.update(i for i, w in enumerate(words) if w[:k] in lexicon.stems)
    odd = [i for i, w in enumerate(words) if not w.isalpha()]
    obfuscated = []
    for i in odd:
        plain = words[i].translate(LEET)
        plain = "".join(c for c in plain if c.isalpha())
        if plain != words[i] and (plain in lexicon.words or plain in lexicon.learned):
            obfuscated.append(i)
    hits = sorted({*seed, *learned, *stems, *obfuscated})
    near = 0
    for i in hits:
        near += any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1])
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, digits = int(byte[65:91].sum()), int(byte[48:58].sum())
    marks = int(byte[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    symbols = int(byte[33:127].sum()) - upper - digits - marks - int(byte[97:123].sum())
    raw = text.split()
    return [
        len(seed), len(seed) / n, len(learned), len(learned) / n, len(stems), len(stems) / n, len(obfuscated), len(obfuscated) / n, len(odd) / n,
        near, near / n, sum(map(str.isupper, raw)) / n, upper / chars, int(byte[33]) / n, marks / n, symbols / n, digits / n,
        len(words), sum(map(len, words)) / n, len(set(words)) / n,
    ]


def family(words: list[str]) -> int:
    """The least hash of the five-word runs: unrelated texts differ in it, copies and most near copies share it."""
    runs = (" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))
    return min(zlib.crc32(r.encode("utf-8", "replace")) for r in runs)


def candidate_terms(words: list[str]) -> set[str]:
    """Words ('=' before them) and their beginnings that a lexicon may take."""
    known = set(words)
    out = {"=" + w for w in known if 3 <= len(w) <= 24}
    for k in STEMS:
        out.update(w[:k] for w in known if len(w) >= k)
    return out


def learn_lexicon(train: DataFrame, least_families: int = 5, least_gain: float = 25.0) -> Lexicon:
    """Terms that training labels mark as toxic.

    ``train`` has (text, y) and is a bounded sample.  Support is counted in families of copies, not rows, so that a text
    copied often does not push its own words in.  ``least_gain`` bounds the likelihood ratio statistic from below.  The
    lexicon is as large as the sample's words make it.
    """

    def one_per_family(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"family": [family(bare_words(t)) for t in b["text"]], "y": b["y"].astype("int32"), "text": b["text"]})

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b["text"], b["y"], strict=True):
                seen[int(y > 0)].update(candidate_terms(bare_words(text)))
            all_terms = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"term": all_terms, "pos": [seen[1][t] for t in all_terms], "neg": [seen[0][t] for t in all_terms]})

    families = (
        train.mapInPandas(one_per_family, "family long, y int, text string").groupBy("family", "y").agg(F.min("text").alias("text"))
    )
    sizes = families.agg(F.sum("y").alias("p"), F.count("y").alias("n")).first()
    p, n = int(sizes["p"] or 0), int(sizes["n"])
    if p == 0 or p == n:
        return Lexicon()
    counted = families.mapInPandas(terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    total = pos + neg
    gain = 2 * (pos * F.log(pos / (total * F.lit(p / n))) + F.when(neg > 0, neg * F.log(neg / (total * F.lit(1 - p / n)))).otherwise(0.0))
    marked = (
        counted.where((F.col("pos") >= least_families) & (pos / p > 10 * (neg + 0.5) / (n - p)))
        .withColumn("gain", gain)
        .where(F.col("gain") >= least_gain)
    )
    found = [r["term"] for r in marked.select("term").collect()]
    return Lexicon(SEED, frozenset(t[1:] for t in found if t[0] == "=") - SEED, frozenset(t for t in found if t[0] != "="))


def fit(train: DataFrame) -> Model:
    """Learn from a bounded sample (doc_id, y, text): lexicon, trees on three quarters of it, calibration on the rest."""
    train = train.withColumn("y", F.col("y").cast("int"))
    lexicon = learn_lexicon(train)

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([features(t, lexicon) for t in b["text"]], dtype=np.float32).reshape(len(b), len(COLUMNS))
            part = [zlib.crc32(b"fold" + str(d).encode()) % 4 for d in b["doc_id"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "part": part, "x": [r.tobytes() for r in x]})

    rows = train.mapInPandas(numbers, "doc_id long, y int, part int, x binary").toPandas().sort_values("doc_id")
    if not len(rows):
        return Model(lexicon)
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), len(COLUMNS)).astype(float)
    y, part = (rows["y"].to_numpy() > 0).astype(float), rows["part"].to_numpy()
    fitted = part != 0 if 0 < y[part != 0].sum() < (part != 0).sum() else np.ones(len(y), bool)
    forest = boosting.fit(x[fitted], y[fitted], trees=60, depth=3)
    if y[~fitted].sum() < 5:  # too few rows to calibrate on: the trees' probabilities stay as they are
        return Model(lexicon, forest)
    return Model(lexicon, forest, boosting.isotonic(forest.probability(x[~fitted]), y[~fitted]))


def scorer(spark: SparkSession, model: Model):
    """A function of a text column that gives its score; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for t in texts:
            x = np.array([features(v or "", model.lexicon) for v in t], dtype=np.float32).astype(float).reshape(len(t), len(COLUMNS))
            yield pd.Series(model.score(x))

    return scored


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """(doc_id, ``out``) for every row of ``docs``; texts are read whole."""
    return docs.select("doc_id", scorer(docs.sparkSession, model)(F.col("text")).alias(out))


def train_and_score(docs: DataFrame, labels: DataFrame, keep=None, max_rows: int = 16_000) -> DataFrame:
    """Fit on labelled rows for which ``keep`` (a condition on labels.doc_id) holds and score all of ``docs``."""
    keep = F.lit(True) if keep is None else keep
    return score(docs, fit(sample(docs, labels, "toxic", keep, max_rows)))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep=None, max_rows: int = 16_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    model = fit(sample(docs, labels, "toxic", F.lit(True) if keep is None else keep, max_rows))
    return docs.where(scorer(docs.sparkSession, model)(F.col("text")) < threshold)
