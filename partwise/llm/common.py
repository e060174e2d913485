"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session on one machine (tests) without ``spark.checkpoint.dir`` gets a
    temporary folder of its own; a cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="partwise-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write to the shared folder once and read it back.

    Unlike ``checkpoint()`` this computes the rows once, stores them by column
    and survives lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/partwise-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    for made in _made:
        made.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._partwise_path = path  # type: ignore[attr-defined]
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_partwise_path", None)
        if path:
            _remove(df.sparkSession, path)


_made: list[list[tuple[SparkSession, str]]] = []


def stored(compute: Callable[[], DataFrame], codec: str = "snappy") -> DataFrame:
    """What ``compute`` gives, written once; all tables that it made on the way are removed."""
    _made.append([])
    try:
        out = materialize(compute(), codec)
    finally:
        made = _made.pop()
    for spark, path in made:
        if path != out._partwise_path:
            _remove(spark, path)
    return out


def ordered_index(df: DataFrame, order: Iterable[Column], name: str) -> DataFrame:
    """Number all rows from 0 in the given order without one task seeing them all.

    Range-partitioned sort, a count for each partition, and a running number
    inside each partition. Ties get numbers in any order.
    """
    order = list(order)
    sorted_rows = materialize(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted_rows.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = counts.select(
        "__part",
        (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__start"),
    )
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        sorted_rows.withColumn("__row", within)
        .join(starts, "__part")
        .withColumn(name, F.col("__start") + F.col("__row") - 1)
        .drop("__part", "__start", "__row")
    )


def digest_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the joined parts: 52 bits, so exact as a double in any engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


#: Bytes of Arrow data that Spark hands a Python worker at once (or one row), and that the worker turns into tuples at a time.
SLICE = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session hands Python workers SLICE bytes at a time from here on: by its own measure, 10,000 rows or 64 MB, JVM and worker hold several times as much."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE))
    return df


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about SLICE bytes: Arrow counts rows, and texts may be long."""
    for b in batches:
        step = max(1, int(b.num_rows * SLICE / max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def map_batches(df: DataFrame, schema: str, fn: Callable[[Iterator[list[tuple]]], Iterator[list[tuple]]]) -> DataFrame:
    """``mapInArrow`` on lists of plain tuples: nulls stay None and long numbers stay exact."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in _slices(batches))
        for out in fn(rows):
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return bounded(df).mapInArrow(run, schema)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
