"""Conversation prefix trie: shared beginnings of conversations, and the tokens that storing them once would save.

Every node belongs to its smallest member. As a child's members are a subset of
its parent's, the nodes that one conversation owns are the end of its path. So a
conversation adds to a node's saved tokens what its path holds between that node
and the first node it owns: one number for each conversation instead of one
subtree for each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.llm.common import discard, materialize

#: Conversations whose numbers agree but for the last two digits begin alike: their first turns come from the first of them, this many at most, less one.
FAMILY, MOST_SHARED = 100, 6
#: Turns of one conversation that a window sorts at a time, and ids that one text lists at a time.
BLOCK = 1024
NODE = ("depth", "n1", "n2")
_LOW = (1 << 32) - 1


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, chars, a, b): turns numbered from 1, with code points and two digests of (role, text).

    Blocks of a conversation are sorted apart and numbered on from the blocks
    before, so that one very long conversation is no single task's work.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.expr(f"CAST(turn AS LONG) DIV {BLOCK}"), F.lit(-(1 << 60))).alias("block"),
        F.length(text).cast("long").alias("chars"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"),
    )
    before = _before(rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")), ["n"])
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    place = F.row_number().over(within).cast("long")
    return rows.withColumn("place", place).join(before, ["conv_id", "block"]).select("conv_id", (F.col("place") + F.col("n")).alias("place"), "chars", "a", "b")


def _before(blocks: DataFrame, sums: list[str]) -> DataFrame:
    """For each block of a conversation the sums of the blocks before it."""
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, a, b, last) of the rebuilt conversations; depth 0 stands for the root."""
    own = materialize(turns(conversations))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST_SHARED)).cast("long")
    heads = own.where((F.col("place") < MOST_SHARED) & (F.col("conv_id") % FAMILY == 0))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", shared.alias("h"), first.alias("base"))
    there = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("there"))
    convs = convs.join(there, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("depths")))
    root = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "chars", "a", "b")], (F.col("depths") == 0).alias("last"))
    begun = convs.join(heads.withColumnRenamed("conv_id", "base"), "base").where("place <= h").withColumn("depth", F.col("place"))
    rest = own.join(convs, "conv_id").where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("m"))
    columns = ["conv_id", "depth", "chars", "a", "b", (F.col("depth") == F.col("depths")).alias("last")]
    out = materialize(root.union(begun.select(*columns)).union(rest.select(*columns)))
    discard(own, convs)
    return out


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, n1, n2, p1, p2, chars, upto, last): each turn with its node, the node above, and the code points up to it.

    A node is told by its depth and 128 bits: sums over the path of digests of
    (depth, turn), in pieces of 32 bits, so that sums of blocks add up.
    """
    digest = [F.xxhash64("depth", "a", "b"), F.xxhash64("depth", "b", "a", F.lit(1))]
    pieces = [p for d in digest for p in (d.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(d, 32))]
    sums = ["s0", "s1", "s2", "s3", "upto"]
    rows = rows.withColumn("block", F.expr(f"depth DIV {BLOCK}"))
    for name, value in zip(sums, [*pieces, F.col("chars")], strict=True):
        rows = rows.withColumn(name, F.when(F.col("depth") > 0, value).otherwise(F.lit(0)).cast("long"))
    before = _before(rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in sums]), sums)
    before = before.select("conv_id", "block", *[F.col(c).alias(f"{c}_before") for c in sums])
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", *[F.sum(c).over(upto).alias(f"{c}_run") for c in sums]).join(before, ["conv_id", "block"])
    at = {c: F.col(f"{c}_run") + F.col(f"{c}_before") for c in sums}
    above = {c: at[c] - F.col(c) for c in sums}
    node = lambda of, x, y: F.xxhash64(of[x], of[y])
    return run.select(
        "conv_id", "depth", node(at, "s0", "s1").alias("n1"), node(at, "s2", "s3").alias("n2"),
        node(above, "s0", "s1").alias("p1"), node(above, "s2", "s3").alias("p2"), "chars", at["upto"].alias("upto"), "last",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node over its blocks of ids, which come in order; only its state is held."""
    node, state = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = key, hashlib.sha256(ids.encode())
        if done:
            yield _ended(done)
    if node is not None:
        yield _ended([(*node, state.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NODE, "ends_sha256"])


def ends(walked: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end.

    Ids are sorted and joined in blocks of BLOCK numbers each; a hash goes on
    from block to block, so many thousand copies cost one task one row a block.
    """
    block = F.expr(f"conv_id DIV {BLOCK}").alias("block")
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = walked.where("last").groupBy(*NODE, block).agg(ids.alias("ids"))
    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").drop("block")
    return dealt.mapInArrow(_digests, "depth long, n1 long, n2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text).

    A node is a distinct sequence of first turns; the root (depth 0) is that of
    none. ``conv_id`` is its smallest member, ``n_leaves`` and ``saved_tokens``
    are sums over its subtree, ``ends_sha256`` tells the conversations that end
    at it.

    Null roles and texts are empty. Turns of one number come in the order of
    their digests, those without a number first; repeated rows are turns of their
    own. Rows without a conv_id belong to no conversation and are left out.
    Conversations may have any number of turns, texts any length. Other columns
    are not looked at. An empty table gives no rows, not even a root.
    """
    rows = rebuilt(conversations)
    walked = materialize(paths(rows))
    discard(rows)
    owned = walked.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("p1", "p2", "chars", "upto")]
    )
    children = owned.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(owned.join(children, [*NODE], "left").fillna(0, ["n_children"]))
    # What a conversation's path holds above the first node it owns, and whether its end is a leaf that it owns.
    firsts = nodes.groupBy("conv_id").agg(F.min(F.col("upto") - F.col("chars")).alias("above"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole = walked.groupBy("conv_id").agg(F.max("upto").alias("whole"))
    marks = whole.join(firsts, "conv_id", "left").select("conv_id", F.coalesce("above", "whole").alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    shared = F.greatest(F.lit(0), F.col("above") - (F.col("upto") - F.col("chars")))
    sums = walked.join(marks, "conv_id").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(shared).alias("saved_tokens"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes_above = nodes.join(parents, ["depth", "p1", "p2"], "left")
    found = nodes_above.join(sums, [*NODE]).join(ends(walked), [*NODE], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
