"""The incremental line index over many batches, against a plain recount after each of them."""

import random

import numpy as np
import pytest

from attestor.llm import cuckoo, line_dedup


class Recount:
    """What the index should hold: lines by document."""

    def __init__(self):
        self.lines: dict[int | None, set[str]] = {}

    def insert(self, rows):
        for d, t in rows:
            self.lines.setdefault(d, set()).update((t or "").split("\n"))

    def delete(self, ids):
        for d in ids:
            self.lines.pop(d, None)

    def drops(self):
        """Number of lines that each document loses."""
        last = line_dedup.LAST
        owners: dict[str, list[int]] = {}
        for d, own in self.lines.items():
            for x in own:
                if len(x) >= line_dedup.LEAST:
                    owners.setdefault(x, []).append(last if d is None else d)
        out: dict[int, int] = {}
        for ids in owners.values():
            for d in ids:
                if d != min(ids):
                    out[d] = out.get(d, 0) + 1
        return out, sorted((min(ids), len(ids)) for ids in owners.values() if len(ids) > 1)


def test_index_over_thirty_batches(spark):
    rng, plain = random.Random(4), Recount()
    index = line_dedup.LineIndex(spark, shards=2, parts=4)
    schema, compacted = "doc_id long, text string", 0
    for batch in range(30):
        if batch % 3 == 2:
            ids = rng.sample([d for d in plain.lines if d is not None], min(3, len(plain.lines) - 1)) + ([None] if batch % 2 else [])
            index.delete(spark.createDataFrame([(d, None) for d in ids], schema))
            plain.delete(ids)
        else:
            rows = [(rng.choice([None, *range(60)]) if rng.random() < 0.3 else 100 * batch + k, "\n".join(f"line of number {rng.randrange(25)}" for _ in range(rng.randrange(4)))) for k in range(6)]
            index.insert(spark.createDataFrame(rows, schema))
            plain.insert(rows)
        compacted += len(index.versions) == 1
        if batch % 4 == 3 or batch in (7, 8, 9, 16, 17, 29):
            drops, refs = plain.drops()
            assert sorted((r["first_doc"], r["refs"]) for r in index.references.collect()) == refs, batch
            assert {r["doc"]: len(r["drop"]) for r in index.probe(None).collect()} == drops, batch
    assert compacted > 2 and index.held and len(index.log) < line_dedup.VERSIONS
    shared = index.n_shared
    assert shared == index.references.count()


def test_a_failed_batch_changes_nothing(spark, monkeypatch):
    index = line_dedup.LineIndex(spark, shards=2, parts=4)
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.insert(make((1, "a line of some length"), (2, "a line of some length")))
    state = dict(vars(index))
    with monkeypatch.context() as m:
        m.setattr(line_dedup.LineIndex, "_refiltered", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.insert(make((3, "a line of some length")))
    assert {k: v for k, v in vars(index).items() if k != "version"} == {k: v for k, v in state.items() if k != "version"}
    index.insert(make((3, "a line of some length")))
    assert [(r["first_doc"], r["refs"]) for r in index.references.collect()] == [(1, 3)]


def test_cuckoo_deletes_many_at_once():
    h = np.random.default_rng(3).integers(0, 2**63, 20_000, dtype=np.uint64)
    f = cuckoo.build(h)
    f.delete(h[:10_000])
    assert f.contains(h[10_000:]).all() and f.contains(h[:10_000]).mean() < 0.01
    assert int((f.table > 0).sum()) == 10_000
    f.delete(h[10_000:])
    assert not f.table.any()
    f.delete(h[:0])
