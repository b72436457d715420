"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are found by patterns; their hashes are counted over distinct repositories and owners of the whole corpus.
A value that several owners have, or that fills many repositories of one owner, is a widely copied example; one of a single
owner and few repositories is live-looking.  Base spans (the three listed kinds) always stay; the two counts decide which
long mixed tokens are added as spans of kind ``live``.

Spans are added up in blocks of ``BLOCK`` matches, and mixed tokens that overlap a base span are found by sorting a text's
spans, so a text with many matches takes no more than its share.

Defined results: null texts are empty; offsets are code points, ends exclusive; rows with a null owner count as one owner
of their own, null repositories as one repository; repeated rows are reported one by one; a row without spans has the
empty string as its list; an empty table gives no rows; clashing column names are of no account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.skew import salted_join
from attestor.llm.storage import saved

# The base patterns, in order of kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Long runs that may be credentials without a name beside them.
MIXED = r"[A-Za-z0-9+/_-]{28,}+"
KINDS = ("assign", "access", "hex", "live")
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
BLOCK = 256


def _spans(text: Column, kind: int, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the matches; lengths of gaps and matches add up to offsets."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gap = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.slice(gap, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    empty = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["whole"])
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        kept = F.when(F.char_length(x["value"]) >= least, F.array_append(acc["out"], found)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    def shifted(block: Column) -> Column:
        return F.transform(
            block["out"], lambda s: F.struct((s["start"] + block["base"]).alias("start"), s["kind"].alias("kind"), (s["end"] + block["base"]).alias("end"), s["value"].alias("value"))
        )

    def follow(acc: Column, x: Column) -> Column:
        block = F.struct(acc["at"].alias("base"), x["out"].alias("out"))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["blocks"], block).alias("blocks"))

    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    starts = F.sequence(F.lit(1), F.size(whole), F.lit(BLOCK))
    blocks = F.transform(starts, lambda at: F.aggregate(F.slice(steps, at, F.lit(BLOCK)), first, step))
    none = F.array().cast(f"array<struct<base:int,out:{SPANS}>>")
    placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("blocks")), follow, lambda acc: acc["blocks"])
    return F.when(text.rlike(pattern), F.flatten(F.transform(placed, shifted))).otherwise(empty)


def scan(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """(row, doc_id, repository, owner, base, mixed) for every row: base spans and long mixed tokens anywhere."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(_spans(text, 0, ASSIGN, 2, 6), _spans(text, 1, ACCESS), _spans(text, 2, HEX)))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"), base.alias("base"), _spans(text, 3, MIXED).alias("mixed"),
    )
    mixed = F.filter("mixed", lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    return saved(found.withColumn("mixed", mixed), "secrets")


def candidates(scanned: DataFrame) -> DataFrame:
    """(row, repository, owner, s, hash) of every base span and of the mixed tokens apart from them."""
    spans = scanned.where("size(base) + size(mixed) > 0").select("row", "repository", "owner", F.explode(F.concat("base", "mixed")).alias("s"))
    is_base = F.col("s.kind") < 3
    in_order = Window.partitionBy("row").orderBy("s.start", "s.end", "s.kind")
    before = F.max(F.when(is_base, F.col("s.end"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    in_reverse = Window.partitionBy("row").orderBy(F.desc("s.start"), F.desc("s.end"), F.desc("s.kind"))
    after = F.min(F.when(is_base, F.col("s.start"))).over(in_reverse.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.coalesce("before", F.lit(0)) <= F.col("s.start")) & (F.coalesce("after", F.col("s.end")) >= F.col("s.end"))
    kept = spans.withColumns({"before": before, "after": after}).where(is_base | apart)
    return saved(kept.select("row", "repository", "owner", "s", F.sha2("s.value", 256).alias("hash")), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners, uses): over how many distinct ones each candidate value is spread, and how often it occurs."""
    hashed = found.select("hash", F.coalesce("repository", F.lit("\0")).alias("repository"), F.coalesce("owner", F.lit("\0")).alias("owner"))
    pairs = hashed.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return owners.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("uses").alias("uses"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def find_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", most_owners: int = 1, most_repositories: int = 20) -> DataFrame:
    """(doc_id, base, spans, n_live, n_shared) for every row of ``docs``.

    ``spans`` holds the base spans and the added live ones as structs (start, kind, end, value).  ``n_live`` counts the
    spans whose value at most ``most_owners`` owners and ``most_repositories`` repositories have, ``n_shared`` the others
    among base and further candidates.
    """
    scanned = scan(docs, repository, owner)
    found = candidates(scanned)
    known = saved(ownership(found), "ownership")
    judged = salted_join(found, known, "hash", "uses", "row").withColumn("own", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))
    by_row = judged.groupBy("row").agg(
        F.count_if("own").alias("n_live"), F.count_if(~F.col("own")).alias("n_shared"),
        F.collect_list(F.when(F.col("own") & (F.col("s.kind") == 3), F.col("s"))).alias("live"),
    )
    out = scanned.join(by_row, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("live", F.array().cast(SPANS))))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "base", spans.alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_shared", zero).alias("n_shared"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base list and the list of all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_shared",
    )
