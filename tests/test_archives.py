"""Zip members as rows, unreadable ones as rejects."""

import io
import zipfile

import numpy as np

from attestor.sources import archives

SCHEMA = "archive string, member string, id long, x double, name string, ok boolean"


def test_members_and_rejects(spark, tmp_path):
    npz, pickled = io.BytesIO(), io.BytesIO()
    np.savez(npz, id=np.array([7, 8]), x=np.array([0.5, np.inf]))
    np.savez(pickled, id=np.array([object()], dtype=object))
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub/a.zip", "w") as z:
        z.writestr("one.csv", 'id,x,name,ok\n1,2.5,"a, b",true\n2,,,FALSE\n')
        z.writestr("two.json", '[{"id": 3, "x": 1, "name": "é", "more": 1}, {"id": null, "name": ["q"]}]')
        z.writestr("lines.json", '{"id": 4}\n\n{"id": 5}\n')
        z.writestr("three.npz", npz.getvalue())
        z.writestr("bad.csv", "id\nnot a number\n"), z.writestr("bad.json", "[{"), z.writestr("bad.npz", pickled.getvalue()), z.writestr("list.json", "[1]")
        z.writestr("readme.txt", "nothing"), z.writestr("empty.json", "[]")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        rows = archives.members(spark, folder, SCHEMA)
        got = {(r["member"], r["id"], r["x"], r["name"], r["ok"]) for r in rows.collect()}
        assert got == {
            ("one.csv", 1, 2.5, "a, b", True), ("one.csv", 2, None, "", False), ("two.json", 3, 1.0, "é", None), ("two.json", None, None, '["q"]', None), ("lines.json", 4, None, None, None),
            ("lines.json", 5, None, None, None), ("three.npz", 7, 0.5, None, None), ("three.npz", 8, float("inf"), None, None),
        }
        assert rows.rdd.getNumPartitions() == 10  # nine members of known kinds and the broken archive
        bad = {(r["archive"].rsplit("/", 1)[1], r["member"]) for r in archives.rejects(spark, folder, SCHEMA).collect()}
        assert bad == {("a.zip", "bad.csv"), ("a.zip", "bad.json"), ("a.zip", "bad.npz"), ("a.zip", "list.json"), ("broken.zip", "")}
    assert archives.members(spark, f"{tmp_path}/sub/a.zip", "id long").where("id is not null").count() == 7


def test_nothing_below(spark, tmp_path):
    assert archives.members(spark, str(tmp_path), "id long").count() == 0 == archives.rejects(spark, str(tmp_path), "id long").count()


def test_round_trip(spark, tmp_path):
    rows = spark.range(40).selectExpr("id", "id % 5 as k", "id / 2 as x", "concat('n', id) as name")
    assert archives.write_members(rows, f"file://{tmp_path}/z", "k", spoiled=1) >= 1
    back = archives.members(spark, f"file://{tmp_path}/z", "id long, k long, x double, name string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_many_small_members_share_partitions(spark, tmp_path):
    for name in "ab":
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for n in range(600):
                z.writestr(f"{name}{n}.json", "[{" if n == 7 else f'[{{"id": {n}}}]')
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    rows = archives.members(spark, str(tmp_path), "member string, id long")
    assert rows.rdd.getNumPartitions() == 5  # two for each archive, one for the broken one
    assert sorted(map(tuple, rows.collect())) == sorted((f"{name}{n}.json", n) for name in "ab" for n in range(600) if n != 7)
    assert {r["member"] for r in archives.rejects(spark, str(tmp_path), "id long").collect()} == {"a7.json", "b7.json", ""}


def test_large_members_part(spark):
    found = [("a", f"{n}.csv", archives.TOGETHER_BYTES // 2 + 1) for n in range(archives.APART + 1)]
    assert [p.names for p in archives.packed(found)] == [(f"{n}.csv",) for n in range(archives.APART + 1)]
