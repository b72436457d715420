"""Places that the driver and all executors can reach.

Everything lasting between two jobs of an operator lives below ``spark.checkpoint.dir``.  A session without that
setting (a test on one machine) gets a folder of its own once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Has Spark delete a job's shuffle files when it ends, and not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder; set here only where the session has none."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="attestor-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one."""
    return f"{shared_root(spark)}/attestor/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Jobs that end within take their shuffle files along; what they wrote is stored and needs none of them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again, which also cuts the lineage."""
    spark = df.sparkSession
    at = fresh(spark, name)
    with shuffles_cleaned(spark):
        df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


class Scratch:
    """A folder for the tables between an operator's jobs, deleted when the ``with`` block ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, fresh(spark, name), 0
        self.places: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)

    def saved(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write ``df`` below the folder, in folders by the columns ``by``, and read it again."""
        self.tables += 1
        at = f"{self.root}/{self.tables:03d}-{name}"
        with shuffles_cleaned(self.spark):
            (df.write.partitionBy(*by) if by else df.write).parquet(at)
        read = self.spark.read.schema(df.schema).parquet(at)
        self.places[id(read)] = read, at
        return read

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that :meth:`saved` returned; nothing that reads them may run after that."""
        for t in tables:
            remove(self.spark, self.places.pop(id(t))[1])


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder that :func:`fresh` named; a missing one is fine."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI (local, S3, GCS, HDFS, ...) and the path in it; usable inside tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_once(uri: str, data: bytes) -> None:
    """Write under a temporary name, then rename, so a lost or repeated task never leaves half a file."""
    at, path = filesystem(uri)
    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with at.open_output_stream(part) as out:
        out.write(data)
    at.move(part, path)


def read_range(uri: str, start: int, length: int) -> bytes:
    """``length`` bytes from ``start``."""
    at, path = filesystem(uri)
    with at.open_input_file(path) as f:
        return f.read_at(length, start)
