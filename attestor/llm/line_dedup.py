"""Line dedup: sharded cuckoo filters in front of exact reference-count tables, reversible per document.

A line's key is the line without ASCII white space at its ends and with A-Z lowered; keys shorter than ten code points
are never dropped.  The index below one folder holds

* a log: for each batch its (digest, doc, change) rows, +1 for a document that gains a key and -1 for one that loses it,
* references: per digest the number of documents and the smallest one, in partitions by digest; a batch writes new rows
  for the digests that it touches, and the newest row of a digest holds,
* filters: per shard of the digests a cuckoo filter of the keys that several documents share.

A batch costs what it touches.  Inserting reads its own rows and the references' partitions that they fall in: counts are
sums of changes, smallest ids the smaller of two.  Deleting finds the documents' keys in the log; only keys that lose
their smallest document look for the next one.  Keys that become shared enter their shard's filter, keys that stop being
shared leave it; filters of other shards stay as they are.

After ``VERSIONS`` batches the versions of the references become one, and the logs one set of held pairs, in partitions by
document: a batch reads the short logs since and the partitions that its documents fall in.  Pairs that were taken back are
gone then.  What a batch writes counts only once all of it is written, so a batch that fails changes nothing.  Replaced files
stay until the next compaction, so results of ``probe`` have to be read before ``VERSIONS`` further batches.

Documents probe the filters first; only keys that pass (shared ones and rare false positives) are joined with the
references, which decide.

Digests are 16 bytes of SHA-256.  Hot lines: postings are counted with partial sums, and both the probes and the join with the
references are salted by document.

Defined results: null and empty texts are one empty line; rows with a null doc_id count as one document that comes last;
rows that repeat a doc_id are one document; inserting a document again adds the keys that it didn't have, deleting one that
the index doesn't hold changes nothing; an empty table has no rows; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import cuckoo
from attestor.llm.skew import salted_join
from attestor.llm.storage import filesystem, fresh, remove, write_once

STRIPPED = b" \t\n\x0b\x0c\r"
LEAST = 10
LAST = 2**63 - 1
SALTS = 32
#: Shards double until each holds about so many shared keys at most, so a filter takes a few MB at any size of corpus.
SHARD_KEYS = 500_000
#: So many versions of the references at most are read side by side.
VERSIONS = 8
REFERENCES = "digest binary, first_doc long, refs long, part int"
CHANGES = "digest binary, doc long, change int"


def line_key(line: bytes) -> bytes:
    return line.strip(STRIPPED).lower()


def key_digest(key: bytes) -> bytes | None:
    """16 bytes for a key that counts, None for a short one."""
    if len(key) < LEAST or (len(key) < 4 * LEAST and len(key.decode("utf-8")) < LEAST):
        return None
    return hashlib.sha256(key).digest()[:16]


def _text(text: str | None) -> bytes:
    return (text or "").encode("utf-8")


def postings(docs: DataFrame) -> DataFrame:
    """(digest, doc): each countable key once per row of ``docs``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests: list[bytes] = []
            owners: list[int] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {d for d in map(key_digest, set(map(line_key, _text(text).split(b"\n")))) if d is not None}
                digests.extend(own)
                owners.extend([doc] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(owners, pa.int64())], ["digest", "doc"])

    return docs.select(_doc().alias("doc"), "text").mapInArrow(keys, "digest binary, doc long")


def _doc():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _hash64(digests: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:] for d in digests), np.uint64)


class LineIndex:
    """Reference counts and filters of the lines of a corpus, below one shared folder."""

    def __init__(self, spark: SparkSession, shards: int = 64, parts: int = 64):
        self.spark, self.root, self.shards, self.parts, self.version = spark, fresh(spark, "lines"), shards, parts, 0
        self.held: str | None = None
        self.log: list[str] = []
        self.versions: list[str] = []
        self.filters: dict[int, str] = {}
        self.replaced: list[str] = []
        self.n_shared = 0

    def insert(self, docs: DataFrame) -> None:
        """Add documents; those that the index holds already gain what they didn't have."""
        added = postings(docs).groupBy("digest", "doc").agg(F.lit(1).alias("change"))
        if self.versions:
            own = docs.select(_doc().alias("doc")).distinct()
            known = self._present(self._logged(own).join(own, "doc", "left_semi"))
            added = added.join(known, ["digest", "doc"], "left_anti")
        path, added = self._written(added)
        delta = added.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
        old = self._touched(delta)
        refs = F.coalesce("refs", F.lit(0))
        self._update(path, old.select("digest", "part", F.least(F.when(refs > 0, F.col("first_doc")), "first").alias("first_doc"), (refs + F.col("n")).alias("refs"), refs.alias("was")))

    def delete(self, docs: DataFrame) -> None:
        """Take documents (by doc_id) out again: all is as if they had never been inserted."""
        if not self.versions:
            return
        gone = docs.select(_doc().alias("doc")).distinct()
        path, removed = self._written(self._present(self._logged(gone).join(gone, "doc", "left_semi")).withColumn("change", F.lit(-1)))
        delta = removed.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
        old = self._touched(delta).withColumn("left", F.col("refs") - F.col("n"))
        orphans = old.where("first <= first_doc and left > 0").select("digest")
        after = self._logged().unionByName(removed)
        heirs = self._present(after.join(orphans, "digest", "left_semi")).groupBy("digest").agg(F.min("doc").alias("heir"))
        self._update(path, old.join(heirs, "digest", "left").select("digest", "part", F.coalesce("heir", "first_doc").alias("first_doc"), F.col("left").alias("refs"), F.col("refs").alias("was")))

    @property
    def references(self) -> DataFrame:
        """(digest, first_doc, refs) of all keys that several documents share."""
        rows = self._rows(self.versions)
        return (rows if len(self.versions) == 1 else self._newest(rows)).where("refs > 1").select("digest", "first_doc", "refs")

    def _path(self, name: str) -> str:
        self.version += 1
        return f"{self.root}/{self.version:05d}-{name}"

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def _logged(self, docs: DataFrame | None = None) -> DataFrame:
        """All changes, or at least those of some documents (doc)."""
        changes = self._read(self.log, CHANGES) if self.log else self.spark.createDataFrame([], CHANGES)
        if not self.held:
            return changes
        held = self._read([self.held], f"{CHANGES}, part int")
        if docs is not None:
            parts = [r["part"] for r in docs.select(_part("doc", self.parts).alias("part")).distinct().collect()]  # ``parts`` rows at most
            held = held.where(F.col("part").isin(parts))
        return held.drop("part").unionByName(changes)

    def _written(self, changes: DataFrame) -> tuple[str, DataFrame]:
        path = self._path("log")
        changes.select("digest", "doc", "change").write.parquet(path)
        return path, self._read([path], CHANGES)

    @staticmethod
    def _present(changes: DataFrame) -> DataFrame:
        """(digest, doc) pairs that hold after all changes."""
        return changes.groupBy("digest", "doc").agg(F.sum("change").alias("held")).where("held > 0").select("digest", "doc")

    def _rows(self, versions: list[str]) -> DataFrame:
        rows = [self._read([p], REFERENCES).withColumn("version", F.lit(n)) for n, p in enumerate(versions)]
        return functools.reduce(DataFrame.unionByName, rows)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("version", "first_doc", "refs")).alias("last")
        return rows.groupBy("digest", "part").agg(last).select("digest", "part", "last.first_doc", "last.refs")

    def _touched(self, delta: DataFrame) -> DataFrame:
        """``delta`` with part, first_doc and refs of its digests, from the partitions that they fall in."""
        delta = delta.withColumn("part", _part("digest", self.parts))
        if not self.versions:
            return delta.withColumns({"first_doc": F.lit(None).cast("long"), "refs": F.lit(None).cast("long")})
        parts = [r["part"] for r in delta.select("part").distinct().collect()]  # ``parts`` rows at most
        rows = self._rows(self.versions).where(F.col("part").isin(parts)).join(delta.select("digest"), "digest", "left_semi")
        return delta.join(self._newest(rows).drop("part", "version"), "digest", "left")

    def _update(self, log: str, changed: DataFrame) -> None:
        """Write the touched references and new filters; then the batch counts, and compaction may follow."""
        path, crossings = self._path("references"), self._path("crossed")
        changed.select("digest", "first_doc", "refs", "was", "part").repartition(self.parts, "part").write.partitionBy("part").parquet(path)
        written = self._read([path], f"{REFERENCES}, was long")
        written.where("(refs > 1) <> (was > 1)").select("digest", F.when(F.col("refs") > 1, 1).otherwise(-1).alias("change")).write.parquet(crossings)
        crossed = self._read([crossings], "digest binary, change int")
        n_shared = self.n_shared + crossed.agg(F.coalesce(F.sum("change"), F.lit(0))).first()[0]
        shards, versions = self.shards, [*self.versions, path]
        while n_shared > shards * SHARD_KEYS:
            shards *= 2
        filters = None if shards > self.shards and self.filters else self._refiltered(crossed, shards)
        if filters is None:
            filters = self._rebuilt(versions, shards)
        self.versions, self.n_shared, self.shards, self.filters = versions, n_shared, shards, filters
        self.log.append(log)
        remove(self.spark, crossings)
        if len(self.versions) > VERSIONS:
            self._compact()

    def _refiltered(self, crossed: DataFrame, shards: int) -> dict[int, str] | None:
        """The filters after keys have crossed into or out of being shared; None if one of them is full."""
        folder, old = self._path("filters"), dict(self.filters)

        def update(key: tuple, changes: pd.DataFrame) -> pd.DataFrame:
            shard = int(key[0])
            h, change = _hash64(changes["digest"]), changes["change"].to_numpy()
            if shard not in old:
                made, full = cuckoo.build(h[change > 0]), False
            else:
                made = _load(old[shard])
                made.delete(h[change < 0])
                full = not made.insert(h[change > 0])
            if not full:
                write_once(f"{folder}/shard-{shard:05d}.cuckoo", made.to_bytes())
            return pd.DataFrame({"shard": [shard], "full": [full]})

        state = crossed.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(update, "shard int, full boolean").collect()  # a row for each shard
        if any(r["full"] for r in state):
            return None
        return old | {r["shard"]: f"{folder}/shard-{r['shard']:05d}.cuckoo" for r in state}

    def _rebuilt(self, versions: list[str], shards: int) -> dict[int, str]:
        """All filters anew from the references: they, or their number, have become too small."""
        folder = self._path("filters")

        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            write_once(f"{folder}/shard-{int(key[0]):05d}.cuckoo", cuckoo.build(_hash64(rows["digest"])).to_bytes())
            return pd.DataFrame({"shard": [int(key[0])]})

        shared = self._newest(self._rows(versions)).where("refs > 1").select("digest", _shard(shards).alias("shard"))
        return {r["shard"]: f"{folder}/shard-{r['shard']:05d}.cuckoo" for r in shared.groupBy("shard").applyInPandas(build, "shard int").collect()}

    def _compact(self) -> None:
        """One version of the references and one set of held pairs in place of many; what they replace goes a turn later."""
        path, held = self._path("references"), self._path("held")
        rows = self._newest(self._rows(self.versions)).where("refs > 0").select("digest", "first_doc", "refs", "part")
        rows.repartition(self.parts, "part").write.partitionBy("part").parquet(path)
        pairs = self._present(self._logged()).select("digest", "doc", F.lit(1).alias("change"), _part("doc", self.parts).alias("part"))
        pairs.repartition(self.parts, "part", F.pmod(F.hash("digest"), F.lit(SALTS))).write.partitionBy("part").parquet(held)
        for old in self.replaced:
            remove(self.spark, old)
        self.replaced = [*self.versions, *self.log, *([self.held] if self.held else [])]
        self.versions, self.log, self.held = [path], [], held

    def probe(self, docs: DataFrame) -> DataFrame:
        """(doc, drop): for documents with lines to drop, the digests of those lines.

        A shared key is dropped in every document but the smallest that the index holds it for.
        """
        if not self.versions:
            return self.spark.createDataFrame([], "doc long, drop array<binary>")
        if docs is not None:
            pairs = postings(docs)
        else:
            pairs = self._logged().select("digest", "doc") if len(self.log) == 1 and not self.held else self._present(self._logged())
        filters, shards = dict(self.filters), self.shards
        pairs = pairs.withColumn("shard", _shard(shards)).repartition("shard", F.pmod(F.hash("doc"), F.lit(SALTS)))

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[int, cuckoo.CuckooFilter | None] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                h = _hash64(b.column(0).to_pylist())
                shard = b.column(2).to_numpy(zero_copy_only=False)
                keep = np.zeros(len(h), bool)
                for s in np.unique(shard).tolist():
                    if s not in loaded:
                        if len(loaded) >= 64:
                            loaded.clear()
                        loaded[s] = _load(filters[s]) if s in filters else None
                    if loaded[s] is not None:
                        rows = np.flatnonzero(shard == s)
                        keep[rows] = loaded[s].contains(h[rows])
                yield b.select(["digest", "doc"]).filter(pa.array(keep))

        candidates = pairs.mapInArrow(passing, "digest binary, doc long")
        drops = salted_join(candidates, self.references, "digest", "refs", "doc").where("doc > first_doc")
        return drops.groupBy("doc").agg(F.collect_set("digest").alias("drop"))


def _part(column: str, parts: int):
    return F.pmod(F.hash(column), F.lit(parts)).cast("int")


def _shard(shards: int):
    return _part("digest", shards)


def _load(uri: str) -> cuckoo.CuckooFilter:
    at, path = filesystem(uri)
    with at.open_input_file(path) as f:
        return cuckoo.CuckooFilter.from_bytes(f.read())


def drop_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` with the text cut to the lines that stay, and n_lines and n_dropped (long) after all its columns.

    Columns of those two names that ``docs`` has already are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    hidden = "drop_lines__"
    while hidden in docs.columns:
        hidden += "_"
    both = docs.join(drops.select(F.col("doc").alias(f"{hidden}doc"), F.col("drop").alias(hidden)), _doc() == F.col(f"{hidden}doc"), "left").drop(f"{hidden}doc")
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, gone = [], [], []
            for text, drop in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                text = text or ""
                if not drop:
                    texts.append(text), sizes.append(text.count("\n") + 1), gone.append(0)
                    continue
                lines, doomed = text.encode("utf-8").split(b"\n"), set(drop)
                stay = [x for x in lines if key_digest(line_key(x)) not in doomed]
                texts.append(b"\n".join(stay).decode("utf-8")), sizes.append(len(lines)), gone.append(len(lines) - len(stay))
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], [*b.schema.names[:-1], "n_lines", "n_dropped"])

    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return both.mapInArrow(cut, schema)


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """Index ``docs`` and drop their repeated lines: all columns, text cut, then n_lines and n_dropped."""
    index = LineIndex(docs.sparkSession)
    index.insert(docs)
    return drop_lines(docs, index.probe(None))
