"""Exact dedup as a log-structured merge index, with DataFrame functions only.

The tasks that read a batch deal its rows to ``MEMTABLES`` memtables, which are flushed in order of their digests.  One after
the other the memtables become runs of level 0: sorted, one row per digest with its smallest id and its number of rows, and a
filter, a bitmap with ``BITS_PER_KEY`` bits a digest.  A new run's digests probe the filters of all runs before it; only
those that pass are looked up there, and what is found is a hit, as is a digest that the memtable has several times.  As
soon as a level holds ``FAN`` runs they are compacted into one of the next level, where again the smallest ids stay, so
every row is rewritten once a level.

A batch is answered for its own rows.  Hits are looked up in the compacted runs, again through their filters; all other rows
are new and alone.  Hits with more than a thousandth of the batch's rows (fewer than a thousand) are broadcast to the rows,
the others joined by digest.  The texts of all hits are compared byte by byte, those of older batches as stored with their
runs; texts that share a digest without being equal are grouped by the text itself.

Defined results: null texts count as empty; a null doc_id is never the smallest unless all ids of a group are null; rows
that repeat a doc_id and its text are one document, so either all or none of them are kept; ids that come again in a later
batch count again; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.storage import fresh, remove, shuffles_cleaned

#: Memtables that a batch fills.
MEMTABLES = 5
#: Runs of a level that are compacted into one.
FAN = 4
#: Bits of a run's filter for each digest; a digest that is not in the run passes with a chance of 1 / BITS_PER_KEY.
BITS_PER_KEY = 16
RUN = "digest binary, keep_id long, group_size long"


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space replaced by one space; null is ''."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


@dataclass(frozen=True)
class Run:
    """A sorted run: its folder, its level, its number of digests and its first and last memtable."""

    path: str
    level: int
    keys: int
    first: int
    last: int


class ExactIndex:
    """Sorted digest runs below one folder, newest last.

    With ``keep_texts`` the normalised texts of every batch stay readable below the folder, which later batches need to
    have their hits verified.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, keep_texts: bool = True):
        self.spark, self.root, self.keep_texts = spark, root or fresh(spark, "exact"), keep_texts
        self.runs: list[Run] = []
        self.batches = self.memtables = self.probes = 0

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Flush a batch's memtables and take them in: its (digest, doc_id) rows and the digests that are hits."""
        batch, self.batches = self.batches, self.batches + 1
        body = normalised("text")
        rows = docs.select(_digest(body).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.monotonically_increasing_id(), F.lit(MEMTABLES)).cast("int").alias("memtable"))
        path, hits = f"{self.root}/memtables-{batch}", f"{self.root}/hits-{batch}"
        rows.sortWithinPartitions("memtable", "digest", "doc_id").write.partitionBy("memtable").parquet(path)
        if self.keep_texts:
            docs.select(_digest(body).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")).write.parquet(f"{self.root}/texts-{batch}")
        flushed = self.spark.read.schema("digest binary, doc_id long, memtable int").parquet(path)
        for m in range(MEMTABLES):
            merged = flushed.where(F.col("memtable") == m).groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            older, run = list(self.runs), self._write(merged, 0, self.memtables, self.memtables)
            self.memtables += 1
            found = self.rows(run).where("group_size > 1").select("digest")
            earlier = self.find(self.rows(run).select("digest"), older)
            if earlier is not None:
                found = found.unionByName(earlier.select("digest"))
            self._store(found, f"{hits}/memtable={m}")
            self.compact()
        found = self.spark.read.schema("digest binary").parquet(*(f"{hits}/memtable={m}" for m in range(MEMTABLES)))
        return flushed.drop("memtable"), self.kept(found.distinct(), f"hit-digests-{batch}")

    def _store(self, rows: DataFrame, path: str) -> None:
        with shuffles_cleaned(self.spark):
            rows.write.parquet(path)

    def kept(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` stored below the index's folder."""
        self._store(rows, f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")

    def _write(self, merged: DataFrame, level: int, first: int, last: int) -> Run:
        """One sorted run with its filter."""
        path = f"{self.root}/run-{level}-{first}-{last}"
        self._store(merged.sortWithinPartitions("digest"), path)
        run = Run(path, level, self.spark.read.schema(RUN).parquet(path).count(), first, last)
        self.write_filter(run)
        self.runs.append(run)
        return run

    def write_filter(self, run: Run) -> None:
        """The bitmap of a run's digests in pieces of 32,768 bits."""
        at = self._position(run)
        bits = self.rows(run).select(F.bitmap_bucket_number(at).alias("piece"), F.bitmap_bit_position(at).alias("bit"))
        self._store(bits.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")), f"{run.path}-filter")

    def _position(self, run: Run) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(max(run.keys, 1) * BITS_PER_KEY)) + 1

    def rows(self, run: Run) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(run.path)

    def passing(self, digests: DataFrame, run: Run) -> DataFrame:
        """The digests that pass a run's filter: all that it holds and a few more."""
        self.probes += 1
        pieces = self.spark.read.schema("piece long, bits binary").parquet(f"{run.path}-filter")
        at = digests.select("digest", F.bitmap_bucket_number(self._position(run)).alias("piece"), F.bitmap_bit_position(self._position(run)).alias("bit"))
        byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bit div 8 as int)") + 1, F.lit(1))), 16, 10).cast("int")
        return at.join(pieces, "piece").where(F.getbit(byte, F.col("bit") % 8) == 1).select("digest")

    def find(self, digests: DataFrame, among: list[Run]) -> DataFrame | None:
        """(digest, keep_id, group_size) for each run of ``among`` that holds one of the digests; None without runs."""
        found = None
        for run in among:
            held = self.rows(run).join(self.passing(digests, run), "digest", "left_semi")
            found = held if found is None else found.unionByName(held)
        return found

    def texts(self, batches: int) -> DataFrame:
        """The normalised texts of the first batches."""
        return self.spark.read.schema("digest binary, doc_id long, body string").parquet(*(f"{self.root}/texts-{b}" for b in range(batches)))

    def compact(self) -> None:
        """Merge each level that has ``FAN`` runs into one run of the next level; the merged runs go."""
        level = 0
        while any(r.level >= level for r in self.runs):
            old = [r for r in self.runs if r.level == level]
            if len(old) >= FAN:
                rows = self.rows(old[0])
                for r in old[1:]:
                    rows = rows.unionByName(self.rows(r))
                self._write(_merged(rows), level + 1, old[0].first, old[-1].last)
                for r in old:
                    self.runs.remove(r)
                    remove(self.spark, r.path)
                    remove(self.spark, f"{r.path}-filter")
            level += 1


def _verified(docs: DataFrame, index: ExactIndex, decided: DataFrame, before: int) -> tuple[DataFrame, DataFrame] | None:
    """The hits whose texts differ although their digests agree, and the rows (digest, doc_id, body, own) that hold them.

    The batch's rows are found by the ids of the hits, so only their texts are normalised again; the texts of the ``before``
    older batches are read back.  Rows without an id are taken as they are.  None if all bytes agree.
    """
    hits = decided.where("group_size > 1")
    ids = hits.where("doc_id is not null").select(F.col("doc_id").alias("hit")).distinct()
    body = normalised("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(ids, F.col("doc_id") == F.col("hit"), "left_semi").unionByName(rows.where("doc_id is null"))
    texts = rows.select(_digest(body).alias("digest"), "doc_id", body.alias("body"), F.lit(True).alias("own"))
    if before:
        older = index.texts(before).join(hits.select("digest").distinct(), "digest", "left_semi")
        texts = texts.unionByName(older.withColumn("own", F.lit(False)))
    differ = texts.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most").select("digest")
    differ = index.kept(differ, f"clashes-{index.batches}")
    if differ.isEmpty():
        return None
    return differ, texts.join(differ, "digest", "left_semi")


def _answered(flushed: DataFrame, groups: DataFrame) -> DataFrame:
    """(digest, doc_id, keep_id, group_size) of all rows, those of hits by their groups, the others alone."""
    many = F.broadcast(groups.where(F.col("group_size") * 1000 > flushed.count()))
    marked = flushed.join(many, "digest", "left")
    rest = marked.where("group_size is null").select("digest", "doc_id").join(groups, "digest", "left")
    alone = F.col("group_size").isNull()
    rest = rest.select("digest", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    return marked.where("group_size is not null").unionByName(rest)


def deduplicate(docs: DataFrame, index: ExactIndex | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``, against all batches of the index.

    The batch is added to the index.  Without one ``docs`` is all there is, and no texts are kept for later batches.
    """
    index = index or ExactIndex(docs.sparkSession, keep_texts=False)
    before = index.batches
    flushed, hits = index.add(docs)
    groups = index.kept(_merged(index.find(hits, index.runs)), f"groups-{index.batches}")
    decided = index.kept(_answered(flushed, groups), f"answers-{index.batches}")
    clashing = _verified(docs, index, decided, before)
    if clashing is not None:
        differ, texts = clashing
        split = texts.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = texts.where("own").join(split, ["digest", "body"]).select("digest", "doc_id", "keep_id", "group_size")
        decided = decided.join(differ, "digest", "left_anti").unionByName(split)
    return decided.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
