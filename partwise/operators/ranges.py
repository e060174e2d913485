"""Sets of byte ranges of files: union, what lies between, and the bytes outside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union(ranges: DataFrame, key: str = "path") -> DataFrame:
    """(key, start, end) of the union of ``ranges`` (key, start, end): ranges that overlap, touch or lie in one another become one.

    In order of starts, a new range begins behind the largest end so far. Empty
    and reversed ranges are none.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > reach, F.lit(True)).cast("long")
    told = ranges.where("end > start").withColumn("begins", begins)
    island = told.withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def cut_out(content: Column, pieces: Column) -> Column:
    """The bytes of disjoint, sorted ``pieces`` (start, end), joined by one pass: as hexadecimal digits, as arrays of bytes have no join."""
    one = lambda p: F.hex(F.substr(content, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))
    return F.unhex(F.array_join(F.transform(pieces, one), ""))


def _between(content: Column, cuts: Column) -> Column:
    """The pieces (start, end) of a content that disjoint, sorted ``cuts`` leave."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: F.least(c["start"], F.octet_length(content).cast("long"))), F.array(F.octet_length(content).cast("long")))
    pieces = F.zip_with(starts, ends, lambda s, e: F.struct(F.greatest(s, F.lit(0)).alias("start"), e.alias("end")))
    return F.filter(pieces, lambda p: p["end"] > p["start"])


def kept(files: DataFrame, ranges: DataFrame, key: str = "path") -> DataFrame:
    """(key, kept, n_ranges, removed_bytes): the ``content`` of each file outside its ``ranges``, which may overlap.

    Ranges are shuffled and sorted once; files meet their cuts in one join. A
    file without ranges stays whole; null content is an empty file.
    """
    held = files.select(key, F.coalesce("content", F.lit(b"")).alias("content"))
    cuts = union(ranges, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    rows = held.join(cuts, key, "left").select(key, "content", F.coalesce("cuts", F.array().cast("array<struct<start:long,end:long>>")).alias("cuts"))
    out = cut_out(F.col("content"), _between(F.col("content"), F.col("cuts")))
    return rows.select(key, out.alias("kept"), F.size("cuts").cast("long").alias("n_ranges"), "content").select(
        key, "kept", "n_ranges", (F.octet_length("content") - F.octet_length("kept")).cast("long").alias("removed_bytes")
    )
