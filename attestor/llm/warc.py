"""WARC archives: write them with an index, then read selected records by coalesced byte ranges.

Every record is its own gzip member.  Each writing task streams records into archives of its own and returns an index
row per record (offset, length, URL, digest, ...).  A reader takes any selection of index rows, sorts them by archive and
offset and merges neighbouring ranges into few large reads.

Defined results: a null payload is empty; equal payloads of at least ``least`` bytes are stored once, as the response of
the smallest id, others are revisits of it; a null id is never the smallest one, and rows that repeat the smallest id are
all responses; a null URL writes no target header; an empty table writes nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.skew import salted_join
from attestor.llm.storage import filesystem, fresh, saved

INDEX = "page_id long, url string, archive string, offset long, length long, digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
ARCHIVE_BYTES = 64 << 20
GAP, MOST = 64 << 10, 8 << 20
#: A reading task fetches about so many bytes of archives; index rows are far too short to size tasks by.
TASK_BYTES = 256 << 20


def _urn(page_id: object) -> str:
    return f"<urn:attestor:page:{'null' if page_id is None else int(page_id)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One uncompressed WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    number = lambda urn: None if urn is None or urn.endswith("null>") else int(urn.rstrip(">").rsplit(":", 1)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is set for payloads that a smaller id has already."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = saved(groups.where("n > 1 and first is not null").select("digest", "first", "n"), "payloads")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return salted_join(rows, shared, "digest", "n", "page_id", "left").select("page_id", "url", "html", "digest", first.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least: int = 100, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write archives of ``pages`` and return their index, itself stored as a table."""
    folder = folder or fresh(pages.sparkSession, "warc")

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        out, name, part, at, size, rows = None, "", "", None, 0, []
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"], strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                if out is None:
                    name, size, rows = f"{folder}/{task:06d}-{uuid.uuid4().hex}.warc.gz", 0, []  # a repeated task has other names
                    at, path = filesystem(name)
                    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    part = f"{path}.part"
                    out = at.open_output_stream(part, compression=None)
                data = gzip.compress(record(page_id, url, html.encode(), digest, refers_to, date), level, mtime=0)
                out.write(data)
                rows.append((page_id, url, name, size, len(data), digest, "response" if refers_to is None else "revisit", refers_to))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    at.move(part, part.removesuffix(".part"))
                    yield _index(rows)
                    out = None
        if out is not None:
            out.close()
            at.move(part, part.removesuffix(".part"))
            yield _index(rows)

    return saved(mark_revisits(pages, least).mapInPandas(archive, INDEX), "warc-index")


def _index(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read(index: DataFrame) -> DataFrame:
    """The records of the selected index rows; a revisit has a null payload and the digest and size of the full one."""
    size = index.agg(F.count_distinct("archive").alias("archives"), F.sum("length").alias("bytes")).first()
    tasks = max(1, min(size["archives"], int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))), (size["bytes"] or 0) // TASK_BYTES)
    chosen = index.select("archive", "offset", "length").repartition(tasks, "archive").sortWithinPartitions("archive", "offset")

    def ranges(b: pd.DataFrame) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        name, start, end, inside = None, 0, 0, []
        for archive, offset, length in zip(b["archive"], b["offset"].tolist(), b["length"].tolist(), strict=True):
            if archive == name and offset <= end + GAP and offset + length - start <= MOST:
                end = max(end, offset + length)
                inside.append((offset - start, length))
                continue
            if inside:
                yield name, start, end - start, inside
            name, start, end, inside = archive, offset, offset + length, [(0, length)]
        if inside:
            yield name, start, end - start, inside

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_name, file = None, None
        for b in batches:
            for name, start, length, inside in ranges(b):
                if name != open_name:
                    at, path = filesystem(name)
                    open_name, file = name, at.open_input_file(path)
                data = file.read_at(length, start)
                found = pd.DataFrame([parse(gzip.decompress(data[o : o + n])) for o, n in inside])
                yield found.astype({"page_id": "Int64", "refers_to": "Int64"})[[c.split()[0] for c in RECORDS.split(", ")]]

    return chosen.mapInPandas(fetch, RECORDS)
