"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.llm.common import digest_unit

SHARDS = 8
ROWS_PER_BUCKET = 20_000


@dataclass(frozen=True)
class Leaf:
    """A shard, and where it stands in the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = SHARDS) -> list[Leaf]:
    """The first ``base`` shards stand two in a rack and two racks in a region.

    Each further shard opens a region of its own. A region's weight is the sum
    below it, so no region that was there before changes its weight: rows move
    only into the new shard.
    """
    leaves = [Leaf(s // 4, s // 2, s) for s in range(min(shards, base))]
    first = leaves[-1].region + 1 if leaves else 0
    return leaves + [Leaf(first + i, (base + 1) // 2 + i, base + i) for i in range(max(0, shards - base))]


def _draw(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The node with the smallest -ln(u)/weight: each wins in proportion to its weight, and a changed weight moves rows only from or to its node."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [
        F.struct((-F.log(digest_unit(key, F.lit(f"{level}{node}"))) / F.lit(float(w))).alias("draw"), F.lit(node).alias("node"))
        for node, w in weights.items()
        if w > 0
    ]
    return F.array_min(F.array(*draws))["node"]


def _sum_by(leaves: list[Leaf], of: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for leaf in leaves:
        out[getattr(leaf, of)] = out.get(getattr(leaf, of), 0.0) + leaf.weight
    return out


def _branch(on: Column, arms: dict[int, Column]) -> Column:
    (_, first), *rest = arms.items()
    out = first
    for node, arm in rest:
        out = F.when(on == node, arm).otherwise(out)
    return out


def assign(df: DataFrame, key: Column, leaves: list[Leaf], prefix: str = "") -> DataFrame:
    """Add ``region``, ``rack`` and ``shard`` (with ``prefix``) for a string key; a null key counts as a key of its own."""
    key = F.coalesce(key, F.lit("∅"))
    regions = _sum_by(leaves, "region")
    df = df.withColumn(f"{prefix}region", _draw(key, "region", regions))
    racks = {r: _draw(key, "rack", _sum_by([x for x in leaves if x.region == r], "rack")) for r in regions}
    df = df.withColumn(f"{prefix}rack", _branch(F.col(f"{prefix}region"), racks))
    shards = {k: _draw(key, "shard", _sum_by([x for x in leaves if x.rack == k], "shard")) for k in _sum_by(leaves, "rack")}
    return df.withColumn(f"{prefix}shard", _branch(F.col(f"{prefix}rack"), shards))


def slots(df: DataFrame, shard: str, tie: list[str], name: str = "slot") -> DataFrame:
    """Number each shard's rows without a gap from 0, in the order of a hash of ``tie``.

    Hash ranges of about ``ROWS_PER_BUCKET`` rows are numbered one by one; the
    counts of the ranges before give the start, so no task sees a whole shard.
    """
    buckets = max(1, df.count() // ROWS_PER_BUCKET)
    draw = digest_unit(F.lit("slot"), *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in tie])
    df = df.withColumn("__draw", draw).withColumn("__bucket", F.floor(F.col("__draw") * buckets))
    counts = df.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    starts = counts.select(shard, "__bucket", before.alias("__start"))
    order = Window.partitionBy(shard, "__bucket").orderBy("__draw", *tie)
    return (
        df.withColumn("__row", F.row_number().over(order))
        .join(starts, [shard, "__bucket"])
        .withColumn(name, (F.col("__start") + F.col("__row") - 1).cast("long"))
        .drop("__draw", "__bucket", "__row", "__start")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put documents into shards under the law ``key``: doc_id and the shard count decide.

    Null text: size 1, checksum 0. Null doc_id: one key of its own. Empty table:
    no rows. Rows that repeat go to one shard and get slots one after another.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    base = docs.select("doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.col("doc_id").cast("string")
    placed = assign(base, key, topology(shards))
    grown = assign(placed, key, topology(shards + 1), "grown_")
    return slots(grown, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"), F.col("region").cast("int").alias("region"), F.col("rack").cast("int").alias("rack"),
    )
