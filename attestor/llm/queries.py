"""The numbered queries: thin digests over the operators of this package, for the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import alignment, bpe, conversation_trie, decontaminate, exact_dedup, licenses, line_dedup, order_minhash, quality, secrets, token_files, toxicity, warc
from attestor.llm.labelled import remainder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    docs = _table(spark, folder, "documents")
    return token_files.read(token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of all pages, written and read back through their index."""
    records = warc.read(warc.write(_table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of toxicity; rows whose crc32(doc_id) mod 3 is 1 are never learned from."""
    docs = _table(spark, folder, "documents")
    scored = toxicity.train_and_score(docs, _table(spark, folder, "labels"), remainder("doc_id", 3) != 1)
    return scored.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What line dedup leaves of every document."""
    cut = line_dedup.deduplicate_lines(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encoding and decoding of all documents."""
    return bpe.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Which of equal documents stays."""
    return exact_dedup.deduplicate(_table(spark, folder, "documents"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Which document holds which benchmark item, with up to 8 % edits."""
    found = decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "distance")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of quality; rows whose crc32(doc_id) mod 5 is 0 are never learned from."""
    docs = _table(spark, folder, "documents")
    scored = quality.train_and_score(docs, _table(spark, folder, "labels"), remainder("doc_id", 5) != 0)
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near-duplicate documents."""
    return order_minhash.classes(_table(spark, folder, "documents"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document; each document is a repository of the owner that its source names."""
    return secrets.digest(secrets.find_secrets(_table(spark, folder, "documents")))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations, the first turns of which are shared within each hundred of ids."""
    return conversation_trie.of_regrown(_table(spark, folder, "conversations"))


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses that every document names or holds."""
    return licenses.scan(_table(spark, folder, "documents"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Where two tokenizers agree on every document, and how usual their links are."""
    return alignment.align(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_secrets": op10_secrets,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_licenses": op12_licenses,
    "op13_alignment": op13_alignment,
}
ORACLE: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to, url
        FROM m""",
    "op4_line_dedup": """
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM s),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        m AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > r.first, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op6_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    # crc32 of a conversation's id bit by bit; prefixes as lists of turns
    "op11_conversation_trie": """
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
                     lambda a, d: list_reduce([xor(a, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, n: xor(x >> 1, (x & 1) * 3988292384))) AS crc
              FROM (SELECT DISTINCT c FROM t)),
        s AS (SELECT c, xor(crc, 4294967295) % 6 AS h FROM h),
        r AS (SELECT s.c, t.pos, t.role, t.text FROM s JOIN t ON t.c = s.c - s.c % 100 AND t.pos <= s.h
              UNION ALL SELECT s.c, t.pos + 1000000 AS pos, t.role, t.text FROM s JOIN t ON t.c = s.c AND t.pos > s.h),
        p AS (SELECT c, row_number() OVER w AS depth, list(row(role, text)) OVER w AS path, length(text) AS chars, count(*) OVER (PARTITION BY c) AS n
              FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)),
        m AS (SELECT c, depth, md5(path::VARCHAR) || depth AS k, md5(path[:-2]::VARCHAR) || (depth - 1) AS up, chars, n FROM p
              UNION ALL SELECT s.c, 0, 'root', NULL, 0, (SELECT count(*) FROM r WHERE r.c = s.c) FROM s),
        g AS (SELECT k, CASE WHEN depth = 1 THEN 'root' ELSE up END AS up, depth, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
                     sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256
              FROM m GROUP BY ALL),
        f AS (SELECT g.*, (SELECT count(*) FROM g AS x WHERE x.up = g.k) AS n_children FROM g),
        a AS (SELECT DISTINCT x.k, y.k AS below FROM m AS x JOIN m AS y ON x.c = y.c AND y.depth >= x.depth),
        o AS (SELECT a.k, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars)::BIGINT AS saved_tokens FROM a JOIN f ON f.k = a.below GROUP BY a.k)
        SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, o.n_leaves, o.saved_tokens, f.ends_sha256
        FROM f JOIN o ON o.k = f.k LEFT JOIN f AS u ON u.k = f.up""",
}
