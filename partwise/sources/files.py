"""Files as rows: batch and streaming sources with a size gate, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Files above this many bytes are not read.
MOST_BYTES = 100 << 20


def read_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, name, length, content, error) of all files below ``path``.

    The size filter reaches the scan, so the bytes of larger files are never
    read; those files come with an error instead.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1).alias("name")
    fits = files.where(F.col("length") <= most).select("path", name, "length", "content", F.lit(None).cast("string").alias("error"))
    over = files.where(F.col("length") > most).select("path", name, "length", F.lit(None).cast("binary").alias("content"), F.lit(f"File exceeds the {most / (1 << 20):.1f} MB limit.").alias("error"))
    return fits.unionByName(over)


def stream_files(spark: SparkSession, path: str, most: int = MOST_BYTES, glob: str = "*") -> DataFrame:
    """The same files as a stream, as they arrive; the bytes of larger ones go no further, and those files come with an error."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    over = F.col("length") > most
    error = F.when(over, F.lit(f"File exceeds the {most / (1 << 20):.1f} MB limit."))
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", F.when(~over, F.col("content")).alias("content"), error.alias("error"))


#: Limits of a ZIP archive without 64-bit records.
MOST_MEMBERS, MOST_SIZE = 0xFFFF, 0xFFFFFFFF


def zip_records(files: DataFrame, name: str = "output_name", data: str = "cleaned", shard: str = "shard") -> DataFrame:
    """(shard, ord, record) whose records, joined in order, are a ZIP archive of stored members for each shard.

    Local headers with data, the central directory and the end record come as
    rows of their own; offsets are running sums of sizes. Time is fixed to
    1980-01-01 and names are UTF-8, so archives come out the same each time. A
    shard with too many members, a name too long or an archive too large raises.
    """
    from partwise.functions.binary import little, raw

    utf8 = F.encode(F.coalesce(F.col(name), F.lit("file")), "UTF-8")
    rows = files.where(F.col(data).isNotNull()).select(F.col(shard).alias("shard"), F.col(name).alias("name"), utf8.alias("utf8"), F.col(data).alias("data"), F.crc32(data).alias("crc"), F.octet_length(data).cast("long").alias("size"))
    order = Window.partitionBy("shard").orderBy("name", "crc", "size")
    whole = F.lit(30) + F.octet_length("utf8") + F.col("size")
    slim = rows.select("shard", "name", "utf8", "crc", "size").withColumn("place", F.row_number().over(order)).withColumn("offset", F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, 0)) - whole)
    long_ = F.when(F.octet_length("utf8") > MOST_MEMBERS, F.raise_error(F.lit("A cleaned filename is too long for ZIP download.")).cast("binary"))
    fixed = F.concat(raw("1400 0008 0000 0000 2100"), little(F.col("crc"), 4), little(F.col("size"), 4), little(F.col("size"), 4), little(F.octet_length("utf8"), 2))
    numbered = rows.withColumn("place", F.row_number().over(order))
    local = numbered.select("shard", F.struct(F.lit(0).alias("k"), "place").alias("ord"), F.concat(F.coalesce(long_, raw("504B0304")), fixed, raw("0000"), F.col("utf8"), F.col("data")).alias("record"))
    central = slim.select("shard", F.struct(F.lit(1).alias("k"), "place").alias("ord"), F.concat(raw("504B0102 1400"), fixed, raw("0000 0000 0000 0000 00000000"), little(F.col("offset"), 4), F.col("utf8")).alias("record"))
    sums = slim.groupBy("shard").agg(F.count("*").alias("n"), F.sum(whole).alias("data"), F.sum(F.lit(46) + F.octet_length("utf8")).cast("long").alias("directory"))
    many = F.when(F.col("n") > MOST_MEMBERS, F.raise_error(F.lit("Too many files for this ZIP download.")).cast("binary"))
    large = F.when((F.col("data") > MOST_SIZE) | (F.col("directory") > MOST_SIZE), F.raise_error(F.lit("Batch is too large for ZIP download.")).cast("binary"))
    end = sums.select("shard", F.struct(F.lit(2).alias("k"), F.lit(0).alias("place")).alias("ord"), F.concat(F.coalesce(many, large, raw("504B0506")), raw("0000 0000"), little(F.col("n"), 2), little(F.col("n"), 2), little(F.col("directory"), 4), little(F.col("data"), 4), raw("0000")).alias("record"))
    return local.union(central).union(end)
