"""Conversation prefix tries by partition refinement.

A conversation is the sequence of its turns; every distinct prefix is a node.  Refinement starts with one class that holds
all conversations.  A round takes the next turns of the active conversations and splits each class turn by turn: the class
of a prefix is named by the digest of its parent's name and the turn, so one grouping yields the nodes of all depths of the
round, with their smallest member and size.  A class left with one conversation is retired: it needs no more splitting, and
the rest of its turns is emitted as a unary chain without any grouping.  Rounds take 1, 2, 4, ... turns up to ``MOST``, so
their number grows with the logarithm of the longest shared prefix, and beyond with that prefix / ``MOST``.

Folding back goes through the rounds from the last to the first.  A node's own leaf and saving are booked on its smallest
member, at its depth; sums from below run up along each active conversation and are added up by node.

Nothing joins on a class: sizes and sums are grouped with partial aggregates, classes of one are found by the id of
their only member, bookings go by conversation and depth.  A node's parent is looked up by digest; parents with more than a
thousandth of all nodes as children (fewer than a thousand) are broadcast.  The turns of one conversation are numbered by
sorted ranges with a base for each, so a conversation with a third of all rows is split as well.  The digest of a node's
ended members reads their ids in order, joined in blocks of ``BLOCK_CHARS`` characters by sorted ranges: a hash runs through
the blocks one after the other, which its definition demands, in bounded memory.

Defined results: rows with a null conv_id belong to no conversation and are left out; null roles and texts are empty; turns
are ordered with null first, equal ones by the digest of role and text, and repeated rows are turns of their own; an empty
table has no nodes; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.storage import Scratch, saved

#: Turns that a round takes at most, a power of two.
MOST = 1024
BLOCK_CHARS = 1 << 16
ROOT = bytes(16)
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SPLIT = "conv long, pos long, name binary, parent binary, chars long, more boolean"
NOTHING = hashlib.sha256(b"").hexdigest()
_EARLY = MOST.bit_length() - 1


def _round(pos: Column) -> Column:
    """The round that takes a turn: 1, 2-3, 4-7, ... and then ``MOST`` turns each."""
    return F.when(pos < MOST, F.length(F.bin(pos)) - 1).otherwise(_EARLY - 1 + F.floor(pos / MOST)).cast("int")


def last_depth(at: int) -> int:
    """The last depth of a round."""
    return 2 ** (at + 1) - 1 if at < _EARLY else MOST * (at - _EARLY + 2) - 1


def _conv() -> Column:
    return F.col("conv_id").cast("long").alias("conv")


def numbered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, n, name, chars) of every turn, stored: its place from 1 among n, the digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select(_conv(), F.col("turn").cast("long").alias("turn"), name.alias("name"), F.char_length(text).cast("long").alias("chars"))
    parts, order = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), ("conv", F.col("turn").asc_nulls_first(), "name")
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = scratch.saved(dealt.select("conv", "name", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sorted")
    spans = dealt.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    of_conv = Window.partitionBy("conv")  # a row for each part
    before = F.coalesce(F.sum("size").over(of_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv", "part", (before - F.col("first") + 1).alias("base"), F.sum("size").over(of_conv).alias("n"))
    turns = scratch.saved(dealt.join(spans, ["conv", "part"]).select("conv", (F.col("at") + F.col("base")).alias("pos"), "n", "name", "chars"), "turns")
    scratch.drop(dealt)
    return turns


def regrown(turns: DataFrame, scratch: Scratch, shared: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % ``shared`` in place of its own first h.

    h is crc32(c) % ``most``.  Returns the turns and (conv, n) of all conversations, of which some have lost all turns.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    heads = turns.where((F.col("pos") < most) & (F.col("conv") % shared == 0)).groupBy("conv").agg(F.collect_list(F.struct("pos", "name", "chars")).alias("heads"))  # most - 1 each
    none = F.array().cast("array<struct<pos:bigint,name:binary,chars:bigint>>")
    convs = turns.groupBy("conv").agg(F.max("n").alias("own")).withColumn("base", F.col("conv") - F.col("conv") % shared)
    convs = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left").withColumn("heads", F.filter(F.coalesce("heads", none), lambda x: x["pos"] <= h))
    convs = scratch.saved(convs.select("conv", "heads", "own", (F.size("heads") + F.greatest(F.col("own") - h, F.lit(0))).alias("n")), "conversations")
    early = convs.select("conv", "n", F.explode("heads").alias("x")).select("conv", "x.pos", "n", "x.name", "x.chars")
    slot = F.floor((F.col("pos") - 1) / MOST)  # so that a long conversation's turns meet its size in many tasks
    sizes = convs.where("own > 0").select("conv", (F.size("heads") - h).alias("by"), F.col("n").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("own") - 1) / MOST))).alias("slot"))
    late = turns.where(F.col("pos") > h).withColumn("slot", slot).join(sizes, ["conv", "slot"]).select("conv", (F.col("pos") + F.col("by")).alias("pos"), F.col("size").alias("n"), "name", "chars")
    return early.unionByName(late), convs.select("conv", "n")


def _split(turns: DataFrame, active: DataFrame | None) -> DataFrame:
    """The turns of a round with the names of their classes (``SPLIT``), each conversation's in a row."""

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, name = None, ROOT
        for b in batches:
            names, parents = [], []
            for conv, start, turn in zip(b["conv"].tolist(), b["class"], b["name"], strict=True):
                if conv != at:
                    at, name = conv, bytes(start)
                parents.append(name)
                name = hashlib.blake2b(name + bytes(turn), digest_size=16).digest()
                names.append(name)
            yield pd.DataFrame({"conv": b["conv"], "pos": b["pos"], "name": names, "parent": parents, "chars": b["chars"], "more": b["more"]})

    rows = turns.select("conv", "pos", "name", "chars", (F.col("pos") < F.col("n")).alias("more"))
    if active is None:  # the first round takes one turn of each
        return rows.withColumn("class", F.lit(ROOT)).mapInPandas(chained, SPLIT)
    return rows.join(active, "conv").repartition("conv").sortWithinPartitions("conv", "pos").mapInPandas(chained, SPLIT)


def _refined(turns: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """The turns with their classes, the nodes, and the active conversations of every round; turns are in folders by round."""
    split, nodes, actives = [], [], []
    active = None
    while True:
        at = len(split)
        here = scratch.saved(_split(turns.where(F.col("round") == at), active), f"split-{at}")
        found = here.groupBy("name", "parent", F.col("pos").alias("depth")).agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("more").alias("more"), F.sum(F.when(F.col("more"), 0).otherwise(1)).alias("ended")
        )
        split.append(here)
        nodes.append(scratch.saved(found, f"nodes-{at}"))
        actives.append(active)
        deepest = last_depth(at)
        retired = nodes[-1].where((F.col("depth") == deepest) & (F.col("n_convs") == 1)).select(F.col("conv_id").alias("conv"))
        active = here.where((F.col("pos") == deepest) & F.col("more")).join(retired, "conv", "left_anti").select("conv", F.col("name").alias("class"))
        active = scratch.saved(active, f"active-{at}")
        if active.isEmpty():
            return split, nodes, actives


def _folded(split: list[DataFrame], nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(name, n_leaves, saved_tokens) of every node, and the sums that are left for the root, by conversation."""
    booked = nodes.select(
        F.col("conv_id").alias("conv"), F.col("depth").alias("pos"), F.col("is_last").cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saving")
    )
    carried, folded = None, []
    for at, here in reversed([*enumerate(split)]):
        deepest = last_depth(at)
        own = booked.where(F.col("pos").between(deepest // 2 + 1 if at < _EARLY else deepest - MOST + 1, deepest))
        rows = here.select("conv", "pos", "name").join(own, ["conv", "pos"], "left").select("conv", "pos", "name", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saving", F.lit(0)).alias("saving"))
        if carried is not None:
            rows = rows.unionByName(carried.select("conv", F.lit(deepest + 1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("name"), "leaves", "saving"))
        rows = scratch.saved(rows, f"booked-{at}")
        upward = Window.partitionBy("conv").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)  # a round's turns at most
        sums = rows.select("name", F.sum("leaves").over(upward).alias("leaves"), F.sum("saving").over(upward).alias("saving")).where("name is not null")
        folded.append(scratch.saved(sums.groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saving").alias("saved_tokens")), f"folded-{at}"))
        carried = scratch.saved(rows.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saving").alias("saving")), f"carried-{at}")
    return reduce(DataFrame.unionByName, folded), carried


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): the SHA-256 of each name's conv ids, ascending and joined by commas."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, first, ids, size = None, None, [], 0
        for b in batches:
            out = []
            for own, conv in zip(b["name"], b["conv"].tolist(), strict=True):
                own = bytes(own)
                if own != name or size > BLOCK_CHARS:
                    if ids:
                        out.append((name, first, ",".join(ids)))
                    name, first, ids, size = own, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield pd.DataFrame(out, columns=["name", "first", "ids"])
        if ids:
            yield pd.DataFrame([(name, first, ",".join(ids))], columns=["name", "first", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, running = None, None
        for b in batches:
            out = []
            for own, ids in zip(b["name"], b["ids"], strict=True):
                own = bytes(own)
                if own == name:
                    running.update(b",")
                else:
                    if running:
                        out.append((name, running.hexdigest()))
                    name, running = own, hashlib.sha256()
                running.update(ids.encode())
            yield pd.DataFrame(out, columns=["name", "ends_sha256"])
        if running:
            yield pd.DataFrame([(name, running.hexdigest())], columns=["name", "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = ends.repartitionByRange(parts, "name", "conv").sortWithinPartitions("name", "conv").mapInPandas(blocks, "name binary, first long, ids string")
    return joined.repartition("name").sortWithinPartitions("name", "first").mapInPandas(digests, "name binary, ends_sha256 string")


def _with_parents(nodes: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """``nodes`` with the smallest member of each one's parent."""
    many = F.broadcast(nodes.where(F.col("n_children") * 1000 > nodes.count()).select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    few = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(root).cast("long"))
    rest = scratch.saved(nodes.where("depth > 1").join(many, "parent", "left"), "parents")
    return first.unionByName(rest.where("parent_conv_id is not null")).unionByName(rest.where("parent_conv_id is null").drop("parent_conv_id").join(few, "parent"))


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes (``NODE``) of conversations (conv, n) with turns (conv, pos, n, name, chars)."""
    spark = turns.sparkSession
    turns = scratch.saved(turns.withColumn("round", _round(F.col("pos"))), "rebuilt", "round")
    whole = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    if not whole["n_convs"]:
        return spark.createDataFrame([], NODE)
    split, found, actives = _refined(turns, scratch)
    nodes = reduce(DataFrame.unionByName, found)
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("below"))
    children = scratch.saved(children, "children")
    nodes = nodes.join(children, "name", "left")  # a class of one without nodes below it ends or goes on as a chain
    nodes = scratch.saved(nodes.withColumns({"is_last": F.col("below").isNull(), "n_children": F.coalesce("below", F.col("more").cast("long"))}).drop("below"), "nodes")
    folded, left = _folded(split, nodes, scratch)
    ends = reduce(DataFrame.unionByName, [s.where("not more").select("name", "conv") for s in split]).unionByName(convs.where("n = 0").select(F.lit(ROOT).alias("name"), "conv"))
    ended = scratch.saved(ends_digests(ends), "ended")
    inner = _with_parents(nodes, whole["conv_id"], scratch).join(folded, "name").join(ended, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    columns = [c.split()[0] for c in NODE.split(", ")]
    return inner.select(columns).unionByName(_chains(turns, actives).select(columns)).unionByName(_root(spark, whole, children, left, ended))


def _chains(turns: DataFrame, actives: list[DataFrame | None]) -> DataFrame:
    """Nodes of the turns that no round took: those of retired conversations."""
    rest = turns.where(F.col("round") >= len(actives))
    for at, active in enumerate(actives):
        if active is not None:
            rest = rest.unionByName(turns.where(F.col("round") == at).join(active, "conv", "left_anti"))
    more = F.col("pos") < F.col("n")
    return rest.select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), more.cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(more, NOTHING).otherwise(F.sha2(F.col("conv").cast("string").cast("binary"), 256)).alias("ends_sha256"),
    )


def _root(spark, whole, children: DataFrame, left: DataFrame, ended: DataFrame) -> DataFrame:
    below = children.where(F.col("name") == F.lit(ROOT)).first()
    sums = left.agg(F.sum("leaves").alias("leaves"), F.sum("saving").alias("saving")).first()
    own = ended.where(F.col("name") == F.lit(ROOT)).first()
    row = (whole["conv_id"], 0, None, whole["n_convs"], below["below"] if below else 0, sums["leaves"] if below else 1, sums["saving"] or 0, own["ends_sha256"] if own else NOTHING)
    return spark.createDataFrame([row], NODE)


def of_regrown(conversations: DataFrame) -> DataFrame:
    """The trie of conversations whose first turns come from another one (see ``regrown``), stored."""
    with Scratch(conversations.sparkSession, "trie") as scratch:
        turns, convs = regrown(numbered(conversations, scratch), scratch)
        return saved(trie(turns, convs, scratch), "trie")


def of_conversations(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are, stored."""
    with Scratch(conversations.sparkSession, "trie") as scratch:
        turns = numbered(conversations, scratch)
        return saved(trie(turns, turns.groupBy("conv").agg(F.max("n").alias("n")), scratch), "trie")
