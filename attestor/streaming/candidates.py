"""Candidates as a stream: staged once each by id, promoted only on confirmation.

A store is a folder of Parquet versions; each micro-batch writes its own new ids under its batch id, so a batch that runs
again after a failure replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CandidateStore:
    """Staged candidates below one folder: ``batch=<n>`` parts and ``status`` changes."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str = "candidate_id"):
        self.spark, self.folder, self.key = spark, folder, key
        self.schema = T.StructType([*schema.fields, T.StructField("status", T.StringType()), T.StructField("batch", T.LongType())])

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def staged(self) -> DataFrame:
        """All candidates with their present status."""
        if not self._exists("parts"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/parts")
        if self._exists("status"):
            changed = self.spark.read.schema(f"{self.key} string, new_status string, at timestamp").parquet(f"{self.folder}/status")
            newest = changed.groupBy(self.key).agg(F.max_by("new_status", F.struct("at", "new_status")).alias("new_status"))
            rows = rows.join(newest, self.key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
        return rows.select(self.schema.names)

    def _ids(self, number: int) -> DataFrame:
        """The ids that other batches have staged: of the parts only the key is read, and no status."""
        if not self._exists("parts"):
            return self.spark.createDataFrame([], self.schema).select(self.key)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/parts").where(F.col("batch") != number).select(self.key)

    def stage(self, batch: DataFrame, number: int) -> None:
        """Add the candidates of a batch that no other batch has; of several with one id, the first by all columns."""
        others = self._ids(number)
        own = [f.name for f in self.schema if f.name not in ("status", "batch", self.key)]
        new = batch.join(others, self.key, "left_anti").groupBy(self.key).agg(F.min(F.struct(*own)).alias("r"))
        rows = new.select(self.key, "r.*").withColumn("status", F.lit("pending_review"))
        rows.select([n for n in self.schema.names if n != "batch"]).write.mode("overwrite").parquet(f"{self.folder}/parts/batch={number}")

    def pending(self) -> DataFrame:
        return self.staged().where("status = 'pending_review'")

    def set_status(self, candidate_id: str, status: str) -> None:
        """Note a change of status; of several the newest holds."""
        change = self.spark.createDataFrame([(candidate_id, status)], f"{self.key} string, new_status string")
        change.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/status")

    def promote(self, candidate_id: str, confirm: bool) -> str:
        """Mark one candidate as promoted and return the id of its source; needs ``confirm``."""
        if not confirm:
            raise PermissionError("promotion needs an explicit confirmation")
        if self.staged().where(F.col(self.key) == candidate_id).isEmpty():
            raise KeyError(candidate_id)
        self.set_status(candidate_id, "promoted")
        return "lit_" + candidate_id.replace(":", "_").replace("/", "_")


def stage_stream(stream: DataFrame, store: CandidateStore, checkpoint: str):
    """Stage what a stream brings, all that is there now; returns the started query."""
    return stream.writeStream.foreachBatch(store.stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Counts by window and keys of events that are at most ``late`` behind."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, time: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    """Runs of events without a gap, with their ends and size."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
