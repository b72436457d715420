"""Token ids as flat files of unsigned integers with 64-bit document offsets, to be mapped into memory.

Documents are dealt by ranges of doc_id, so shard after shard they ascend.  Each task encodes its documents and writes a
shard of three files: ``.ids`` (unsigned integers of ``width`` bytes), ``.offsets`` (n + 1 unsigned 64-bit positions within
the shard) and ``.docs`` (signed 64-bit ids).  The bases of the shards are the prefix sum of their token counts.

Defined results: a null text is empty and consists of the end id alone; null ids come first, as the id NULL_ID in the
files; rows that repeat an id follow each other in order of their text; an empty table has no shards.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.memory import Remembered
from attestor.llm.storage import filesystem, fresh, saved, write_once

NULL_ID = -(2**63)
SHARDS = "path string, first_doc long, n_docs long, n_ids long, width int"
#: Bytes that a Python worker remembers of encoded words.
ROOM_WORDS = 96 << 20
#: Spaces at which every text may be cut without changing its ids: no token and no merge crosses them.
CUTS = str.maketrans("\n\t\r", "   ")
MARKS = ".,;:!?#%&*$|"


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


BYTE_SIGNS = _byte_signs()


def _signs(word: str) -> str:
    return "".join(map(BYTE_SIGNS.__getitem__, word.encode("utf-8")))


class WordEncoder(Remembered):
    """Encodes texts word by word and remembers words; the ids are those of the tokenizers library for the whole text.

    The tokenizer's first steps (normal form, lower case, split) never join characters over a space, so a text's ids are
    the ids of its space-separated chunks in turn.  A chunk of plain letters with marks after it is looked up as the
    lower-case word and the marks, which its pattern separates; a plain lower-case word is in normal form already and goes
    straight to the library's merges (``model.tokenize``).  All other chunks, also those that hold the string of a special
    token, go through the whole library.
    """

    def __init__(self, path: str, width: np.dtype, special_as_text: bool):
        from tokenizers import Tokenizer

        super().__init__(self._ids, ROOM_WORDS)
        self.library, self.width = Tokenizer.from_file(path), width
        self.library.encode_special_tokens = special_as_text

    def _ids(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        if core.isalpha() and max(core) < "ɐ" and "İ" not in core:
            low = core.lower()
            if low != chunk:
                return self[low] + (self[chunk[len(core) :]] if len(core) < len(chunk) else b"")
            return np.array([t.id for t in self.library.model.tokenize(low if low.isascii() else _signs(low))], self.width).tobytes()
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, self.width).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.translate(CUTS).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")))


@functools.cache
def encoder(path: str, width: str, special_as_text: bool) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path, np.dtype(width), special_as_text)


def write(
    docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = 2, shards: int | None = None, folder: str | None = None, special_as_text: bool = False
) -> DataFrame:
    """Encode ``docs`` into shards and return a row for each (``SHARDS``), itself stored as a table.

    ``width`` is 2 for vocabularies of at most 65,536 ids, else 4.  ``shards`` is Spark's number of shuffle partitions
    unless given.  The string of a special token in a text gets that token's id, as is the library's default, unless
    ``special_as_text``.
    """
    spark = docs.sparkSession
    folder = folder or fresh(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = f"<u{width}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/{uuid.uuid4().hex}"  # a repeated task writes under another name
        end, words = np.array([end_id], kind).tobytes(), encoder(tokenizer, kind, special_as_text)
        offsets, ids, at, position = [0], [], None, 0
        out = None
        for b in batches:
            if out is None:
                at, local = filesystem(f"{path}.ids")
                at.create_dir(local.rsplit("/", 1)[0], recursive=True)
                out = at.open_output_stream(f"{local}.part", compression=None)
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                data = words.encode(text)
                out.write(data), out.write(end)
                position += len(data) // width + 1
                offsets.append(position)
                ids.append(NULL_ID if pd.isna(doc) else int(doc))
        if out is not None:
            out.close()
            at.move(f"{local}.part", local)
            write_once(f"{path}.offsets", np.array(offsets, "<u8").tobytes())
            write_once(f"{path}.docs", np.array(ids, "<i8").tobytes())
            yield pd.DataFrame({"path": [path], "first_doc": [ids[0]], "n_docs": [len(ids)], "n_ids": [position], "width": [width]})

    return saved(dealt.mapInPandas(shard, SHARDS), "token-shards")


def based(shards: DataFrame) -> list[tuple[str, int, int]]:
    """(path, base, width) in ascending order: the prefix sum over the shards, one short row each."""
    base, out = 0, []
    for r in sorted(shards.collect(), key=lambda r: r["first_doc"]):
        out.append((r["path"], base, r["width"]))
        base += r["n_ids"]
    return out


class Shard:
    """One shard, mapped into memory where its file system is local and read whole elsewhere."""

    def __init__(self, path: str, width: int):
        self.ids, self.offsets, self.docs = self._map(f"{path}.ids", f"<u{width}"), self._map(f"{path}.offsets", "<u8"), self._map(f"{path}.docs", "<i8")

    @staticmethod
    def _map(uri: str, kind: str) -> np.ndarray:
        at, path = filesystem(uri)
        if at.type_name == "local":
            return np.memmap(path, kind, "r")
        with at.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), kind)

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[int(self.offsets[i]) : int(self.offsets[i + 1])]


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone, a task for each shard."""
    spark, places = shards.sparkSession, based(shards)
    plan = spark.createDataFrame(places, "path string, base long, width int").repartition(max(1, len(places)), "path")

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, base, width in zip(b["path"], b["base"], b["width"], strict=True):
                s = Shard(path, width)
                for k in range(0, len(s), 2_000):
                    n = range(k, min(len(s), k + 2_000))
                    ids = pd.array([int(s.docs[i]) for i in n], "Int64")
                    ids[np.asarray(s.docs[k : k + len(n)]) == NULL_ID] = pd.NA
                    o = s.offsets[k : k + len(n) + 1].astype(np.int64)
                    yield pd.DataFrame({"doc_id": ids, "start": base + o[:-1], "n_tokens": np.diff(o), "ids_crc32": [zlib.crc32(s[i].astype("<u4").tobytes()) for i in n]})

    return plan.mapInPandas(checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
