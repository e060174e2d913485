"""Files as they arrive: the same pass, without state, into Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partwise.functions.scalars import clean_name
from partwise.operators.clean import clean
from partwise.plans.process import analyze, process


def clean_stream(files: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Clean each arriving file once and append (path, name, output_name, file_type, error, cleaned, removed_bytes) to ``out``.

    Files over the size gate (see ``stream_files``) come as rows with an error.
    """
    keyed = files.withColumn("key", F.struct("path", "name", F.col("error").alias("gate")))
    rows = clean(analyze(keyed.select("key", "content"), "key", content=True), "key")
    told = rows.select(
        "key.path", "key.name", clean_name(F.col("key.name")).alias("output_name"), F.when(F.col("key.gate").isNull(), F.col("file_type")).alias("file_type"),
        F.coalesce("key.gate", "error").alias("error"), "cleaned", "removed_bytes",
    )
    writer = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def prove_stream(files: DataFrame, out: str, errors: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Clean each arriving file, read it again as proof, and store (path, length, name, output_name, file_type, cleaned, removed_bytes, remaining, status) in ``out``.

    Files that fail, at the gate or later, go to ``errors`` (path, length, name,
    file_type, error). Each batch owns the folder ``batch=<number>`` of both and
    writes it anew: a batch that runs again after a loss replaces its rows, so
    each file is told once.
    """

    def store(batch: DataFrame, number: int) -> None:
        keyed = batch.select(F.struct("path", "length", "name", F.col("error").alias("gate")).alias("key"), "content")
        done = process(keyed, "key").persist()
        try:
            error = F.coalesce("key.gate", "error")
            failed = done.where(error.isNotNull()).select("key.path", "key.length", "key.name", F.when(F.col("key.gate").isNull(), F.col("file_type")).alias("file_type"), error.alias("error"))
            sound = done.where(error.isNull()).select("key.path", "key.length", "key.name", clean_name(F.col("key.name")).alias("output_name"), "file_type", "cleaned", "removed_bytes", "remaining", "status")
            sound.write.mode("overwrite").parquet(f"{out}/batch={number}")
            failed.write.mode("overwrite").parquet(f"{errors}/batch={number}")
        finally:
            done.unpersist()

    writer = files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
