"""Members of zip archives as rows, through a data source of Spark's own kind: a partition for each member, or for several small ones.

``spark.read.format("zip_members").schema(...).load(folder)`` reads every ``*.zip`` below a folder, or one archive.  Members are CSV with a header, JSON
(a list of objects, or one object a line) or npz (arrays of one length), by their suffix; others are passed over.  Columns are
taken by name and cast to the declared schema; ``member`` and ``archive`` name where a row is from.  Nothing is unpickled.

A member that can't be read, or has a value that is none of its declared type, gives no rows at all.  With the option
``rejects_of``, the declared schema as JSON, the source returns just these: (archive, member, error).
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

REJECTS = "archive string, member string, error string"
KINDS = (".csv", ".json", ".npz")
#: Up to so many members are a partition each; of more, a partition takes so many neighbours of one archive, or so many of their bytes.
APART, TOGETHER, TOGETHER_BYTES = 64, 500, 16_000_000
_WHOLE, _REAL = (LongType, IntegerType, ShortType), (DoubleType, FloatType)


@dataclass
class Members(InputPartition):
    """Some members of one archive; an archive that can't be opened has one without a name."""

    archive: str
    names: tuple[str, ...]


def packed(found: list[tuple[str, str, int]]) -> list[Members]:
    """Partitions of (archive, member, bytes): their number grows with the bytes, not with the members."""
    if len(found) <= APART:
        return [Members(archive, (name,)) for archive, name, _ in found]
    out: list[Members] = []
    for archive, own in itertools.groupby(found, key=lambda m: m[0]):
        names, held = [], 0
        for _, name, n in own:
            if names and (len(names) == TOGETHER or held + n > TOGETHER_BYTES):
                out.append(Members(archive, tuple(names)))
                names, held = [], 0
            names.append(name)
            held += n
        out.append(Members(archive, tuple(names)))
    return out


def _place(uri: str):
    """The Arrow file system of a URI and the path in it, usable in tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:") and not uri.startswith("file://") else uri)


def archives_below(uri: str) -> list[str]:
    """The paths of all zip archives at or below a URI, in order."""
    from pyarrow import fs

    files, path = _place(uri)
    if files.get_file_info(path).type == fs.FileType.File:
        return [uri]
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    found = files.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))


def parsed(name: str, data: bytes) -> Iterator[dict]:
    """The rows of one member."""
    if name.endswith(".csv"):
        yield from csv.DictReader(io.StringIO(data.decode("utf-8")), strict=True)
    elif name.endswith(".json"):
        text = data.decode("utf-8")
        rows = json.loads(text) if text.lstrip().startswith("[") else [json.loads(line) for line in text.splitlines() if line.strip()]
        for row in rows:
            if not isinstance(row, dict):
                raise ValueError("not a list of objects")
            yield row
    else:
        import numpy as np

        with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
            columns = {k: arrays[k].tolist() for k in arrays.files}
        if len({len(c) for c in columns.values()}) > 1:
            raise ValueError("arrays of different lengths")
        yield from (dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True))


def _cast(value: object, kind) -> object:
    """A value of the declared type; empty texts are null."""
    if value is None or value == "" and not isinstance(kind, StringType):
        return None
    if isinstance(kind, _WHOLE):
        return int(value)
    if isinstance(kind, _REAL):
        return float(value)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else {"true": True, "false": False}[str(value).lower()]
    return value if isinstance(value, str) else json.dumps(value)


class MemberReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        declared = options.get("rejects_of")
        self.rejects, self.path = declared is not None, options["path"]
        self.schema = StructType.fromJson(json.loads(declared)) if declared else schema

    def partitions(self) -> list[InputPartition]:
        """Partitions of the members of all archives; an archive that can't be opened counts as one member."""
        found = []
        for archive in archives_below(self.path):
            files, path = _place(archive)
            try:
                with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    found += [(archive, m.filename, m.file_size) for m in z.infolist() if m.filename.endswith(KINDS)]
            except (zipfile.BadZipFile, OSError, ValueError):
                found.append((archive, "", 0))
        return packed(found) or [Members("", ())]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.names:
            return
        archive = partition.archive
        files, path = _place(archive)
        try:
            with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for name in partition.names:
                    yield from self._member(z, archive, name)
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            if self.rejects:
                yield from ((archive, name, f"{type(e).__name__}: {e}") for name in partition.names)

    def _member(self, z: zipfile.ZipFile, archive: str, name: str) -> Iterator[tuple]:
        """All rows of a member, or none and a reject."""
        place, columns = {"archive": archive, "member": name}, [(c.name, c.dataType) for c in self.schema]
        try:
            rows = [tuple(_cast(r.get(c), kind) for c, kind in columns) for r in (r | place for r in parsed(name, z.read(name)))]
        except Exception as e:  # noqa: BLE001  whatever is wrong with a member, it's a reject
            if self.rejects:
                yield archive, name, f"{type(e).__name__}: {e}"
            return
        if not self.rejects:
            yield from rows


class ZipMembers(DataSource):
    """The data source ``zip_members``."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return REJECTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(schema, self.options)


def members(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all readable members below a folder."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").schema(schema).load(folder)


def rejects(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(archive, member, error) of the members below a folder that can't be read as rows of a schema."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("rejects_of", StructType.fromDDL(schema).json()).schema(REJECTS).load(folder)


def write_members(rows: DataFrame, folder: str, by: str, spoiled: int = 0) -> int:
    """Zip archives of ``rows``, one for each task, with a member for each value of ``by``, by turns in the three kinds.

    Returns the number of archives.  ``spoiled`` members a task are added that can't be read.
    """
    import uuid

    import pandas as pd

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for key, own in pd.concat(parts).groupby(by):
                kind = int(key) % 3
                if kind == 0:
                    z.writestr(f"m{key}.csv", own.to_csv(index=False))
                elif kind == 1:
                    z.writestr(f"m{key}.json", own.to_json(orient="records", lines=bool(key % 2)))
                else:
                    out = io.BytesIO()
                    np.savez(out, **{c: own[c].to_numpy().astype(str) if own[c].dtype == object else own[c].to_numpy() for c in own.columns})
                    z.writestr(f"m{key}.npz", out.getvalue())
            for n in range(spoiled):
                z.writestr(f"spoiled{n}.json", b'[{"half')
        files, path = _place(f"{folder}/{uuid.uuid4().hex}.zip")
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(path + ".part") as f:
            f.write(held.getvalue())
        files.move(path + ".part", path)
        yield pd.DataFrame({"path": [path]})

    return rows.repartition(by).mapInPandas(archive, "path string").count()
