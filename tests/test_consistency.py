"""Consistency of documents against the sequential rule, and how many rows it moves."""

import random
from collections import Counter

from attestor.operators import consistency, matching

SCHEMA = "model string, source_id string, property string, pos long, value array<double>, conditions map<string,double>, text string"
NONE = "model string, source_id string, property string"


def sequential(gold, echoes):
    """(model, a, b, property, text of a, text of b) of every entry of both documents once."""
    out, docs = Counter(), lambda rows: {r[:2] for r in rows if r[0] is not None}
    pairs = {(m, a, b) for m, a in docs(gold) for n, b in docs(echoes) if m == n and a != b} | {(m, a, b) for m, a in docs(gold) for n, b in docs(gold) if m == n and a < b}
    order, point = lambda r: (r[3], r[6]), lambda r: (r[4] or [0.0])[0] or 0.0
    for m, a, b in pairs:
        for prop in {r[2] for r in gold + echoes if r[0] == m and r[1] in (a, b)}:
            left = sorted((r for r in gold if r[:3] == (m, a, prop)), key=order)
            right = sorted((r for r in gold + echoes if r[:3] == (m, b, prop)), key=order)
            free = [dict.fromkeys(range(len(side))) for side in (left, right)]
            for _, i, j in sorted((abs(point(x) - point(y)), i, j) for i, x in enumerate(left) for j, y in enumerate(right)):
                if i in free[0] and j in free[1]:
                    del free[0][i], free[1][j]
                    out[m, a, b, prop, left[i][6], right[j][6]] += 1
            out.update((m, a, b, prop, left[i][6], None) for i in free[0])
            out.update((m, a, b, prop, None, right[j][6]) for j in free[1])
    return out


def shuffled(spark, since):
    """Rows that stages beyond ``since`` wrote to shuffles, and the last stage."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    each = [(s.stageId(), s.shuffleWriteRecords()) for s in (stages.apply(k) for k in range(stages.size()))]
    return sum(n for k, n in each if k > since), max((k for k, _ in each), default=-1)


def test_entries_of_all_pairs_against_the_sequential_rule(spark):
    """Equal positions, ranges, entries without a value, names or properties that are null, and a document that is gold and echo."""
    rng, number = random.Random(4), iter(range(10_000))

    def entries(sources, n):
        rows = []
        for model, source, prop in ((m, s, p) for m in ("m", "n", None) for s in sources for p in ("mass_g", "height_mm", None)):
            values = [rng.choice([None, [], [0.0], *([float(x)] for x in range(9)), [2.0, 3.0], [rng.random() * 9]]) for _ in range(rng.randrange(n))]
            places = rng.sample(range(500), len(values))
            for value, pos in zip(values, places, strict=True):
                rows += [(model, source, prop, pos, value, {"dod_pct": 1.0}, f"{next(number):05d} {value}") for _ in range(rng.choice([1, 1, 1, 2]))]
        return rows

    gold, echoes = entries(["datasheet_a", "datasheet_b", "datasheet_c"], 25), entries(["review_x", "review_y", "datasheet_b"], 12)
    rows = consistency.consistency(spark.createDataFrame(gold, SCHEMA), spark.createDataFrame(echoes, SCHEMA), spark.createDataFrame([], NONE)).collect()
    assert Counter((r["model"], r["source_a"], r["source_b"], r["property"], r["text_a"], r["text_b"]) for r in rows) == sequential(gold, echoes)
    known = {r[6]: (r[3], r[4]) for r in gold + echoes}
    for r in rows:
        assert (r["i"], r["value_a"]) == known.get(r["text_a"], (None, None)) and (r["j"], r["value_b"]) == known.get(r["text_b"], (None, None))
        assert (r["verdict"] == "coverage_gap") == (r["text_a"] is None or r["text_b"] is None)


def test_entries_move_once_for_any_number_of_pairs(spark):
    """A document of 3,000 entries against twenty short ones: its entries are no rows of a shuffle for each pair."""
    gold = [("m", "datasheet_a", "mass_g", n, [float(n % 40)], {}, "") for n in range(3000)]
    echoes = [("m", f"review_{k}", "mass_g", n, [float(50 + n)], {}, "") for k in range(20) for n in range(3)]
    _, last = shuffled(spark, -1)
    rows = consistency.consistency(spark.createDataFrame(gold, SCHEMA), spark.createDataFrame(echoes, SCHEMA), spark.createDataFrame([], NONE))
    assert consistency.summary(rows).first().asDict() == {"model": "m", "n": 60_000, "consistent": 0, "condition_mismatch": 0, "document_variant_conflict": 60, "coverage_gap": 59_940}
    assert shuffled(spark, last)[0] < 3 * len(gold)


def test_sides_apart_are_matched_without_their_rows(spark, monkeypatch):
    """One side's values are all below the other's, more than there are rounds: the n-th rows from the middle meet."""
    handled, keep = [], matching.by_group
    monkeypatch.setattr(matching, "by_group", lambda rows, *rest: handled.append(rows.count()) or keep(rows, *rest))
    schema, sides = "k string, pos long, value double", ([], [])
    for k, (low, high) in (("up", (0, 1)), ("down", (1, 0))):
        sides[low].extend((k, 7 * n % 400, float(n % 37)) for n in range(400))
        sides[high].extend((k, n, 100.0 + n * n) for n in range(30))
    got = {tuple(r) for r in matching.greedy_pairs(*(spark.createDataFrame(s, schema) for s in sides), ["k"], "value").collect()}
    want = set()
    for k, low in (("up", 0), ("down", 1)):
        below, above = ([r for r in sides[s] if r[0] == k] for s in (low, 1 - low))
        met = list(zip((p for _, p, v in sorted(below, key=lambda r: (-r[2], r[1]))), (p for _, p, v in sorted(above, key=lambda r: r[2])), strict=False))
        rest = [(p, None) for _, p, _ in below if p not in {x for x, _ in met}]
        want |= {(k, *(pair if low == 0 else pair[::-1])) for pair in met + rest}
    assert got == want and sum(handled) == 0


def test_a_tie_with_a_value_that_has_something_closer_waits(spark):
    """1 is as far from 0 as from 2, which first meets 1.5; of what is left of 0 and 2 the first position counts."""
    a, b = [("x", 0, 1.0), ("x", 1, 1.5)], [("x", 5, 0.0), ("x", 3, 2.0), ("x", 4, 2.0)]
    got = matching.greedy_pairs(spark.createDataFrame(a, "k string, pos long, value double"), spark.createDataFrame(b, "k string, pos long, value double"), ["k"], "value")
    assert {tuple(r) for r in got.collect()} == {("x", 1, 3), ("x", 0, 4), ("x", None, 5)}
