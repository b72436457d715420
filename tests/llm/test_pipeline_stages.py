"""The corpus pipeline against plain versions of its stages, on the shorter documents of the small table."""

import base64
import hashlib
import shutil

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from attestor.llm import queries
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_pipeline import plain_matches

FOLDER, LONGEST = "/root/testdata/sf0.001", 6_000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    docs = pq.read_table(f"{FOLDER}/documents.parquet")
    pq.write_table(docs.filter([len(t or "") < LONGEST for t in docs["text"].to_pylist()]), at / "documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{FOLDER}/{name}.parquet", at / f"{name}.parquet")
    return str(at)


def without_repeated_lines(texts):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    gone = {k: min(ds) for k, ds in holders.items() if len(ds) > 1}
    return {d: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), d) == d) for d, t in texts.items()}


def test_pipeline_equals_plain_stages(spark, folder, tmp_path):
    import corpus_pipeline
    import tiktoken

    table = lambda name, a, b: {r[a]: r[b] for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()}
    texts, items, stages = table("documents", "doc_id", "text"), table("benchmark", "item_id", "text"), dict(corpus_pipeline.STAGES)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        stages[name](spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept["toxicity"] and kept["toxicity"].items() <= texts.items()
    scores = {r["doc_id"]: r["predicted"] for r in queries.op3_toxicity(spark, folder).collect()}
    assert kept["toxicity"].keys() == {d for d, bad in scores.items() if not bad}
    assert kept["line_dedup"] == without_repeated_lines(kept["toxicity"])
    classes = brute_classes(kept["line_dedup"])
    assert kept["near_dedup"] == {d: t for d, t in kept["line_dedup"].items() if classes[d] == d}
    leaks = {d for d, _ in plain_matches(kept["near_dedup"], items)}
    assert kept["decontamination"].keys() == kept["near_dedup"].keys() - leaks and leaks
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    ids = {d: np.array(library.encode_ordinary(t), "<u4") for d, t in kept["decontamination"].items()}
    assert got == {d: (len(x), hashlib.sha256(x.tobytes()).hexdigest()) for d, x in ids.items()}
