"""A sink of whole files with commit: what a task writes shows only when the job is done."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from partwise.operators.documents import safe_name

FORMAT = "partwise_files"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, each with the place where it waits."""

    files: dict[str, str] = field(default_factory=dict)


class FileWriter(DataSourceWriter):
    """Joins the records of each file in a folder of the job; ``commit`` moves the files of the tasks that count, whatever else is left goes.

    An attempt writes below a name of its own, so a task that is lost and runs
    again, or runs twice, leaves nothing of its other attempt.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.waiting = os.path.join(folder, f".writing-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Written:
        own = os.path.join(self.waiting, uuid.uuid4().hex)
        os.makedirs(own, exist_ok=True)
        done, name, out = Written(), None, None
        try:
            for r in rows:
                if out is None or r["file"] != name:
                    if r["file"] in done.files:
                        raise ValueError(f"the records of {r['file']} do not come together")
                    if out is not None:
                        out.close()
                    name = r["file"]
                    done.files[name] = os.path.join(own, f"{len(done.files)}")
                    out = open(done.files[name], "wb")  # noqa: SIM115
                out.write(r["record"])
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of one name")
        for m in done:
            for name, place in m.files.items():
                os.replace(place, os.path.join(self.folder, name))
        shutil.rmtree(self.waiting, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.waiting, ignore_errors=True)


class Files(DataSource):
    """Rows (file, record) as files below a folder that driver and executors mount."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        folder = self.options["path"].removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        return FileWriter(folder)


def write_records(records: DataFrame, folder: str) -> None:
    """(file, ord, record): the records of each file, joined in order, below ``folder``.

    Each file is written by one task, record by record. Names that lead out of
    the folder raise. Files that are there are replaced when the job is done; a
    job that fails changes nothing.
    """
    bad = F.raise_error(F.concat(F.lit("Not a name inside the folder: "), F.coalesce("file", F.lit("null")))).cast("string")
    ok = F.coalesce(safe_name(F.col("file")) & ~F.contains("file", F.lit("/")) & ~F.startswith("file", F.lit(".writing-")) & ~F.col("file").isin(".", ".."), F.lit(False))
    rows = records.select(F.when(ok, F.col("file")).otherwise(bad).alias("file"), "ord", "record")
    records.sparkSession.dataSource.register(Files)
    dealt = rows.repartition("file").sortWithinPartitions("file", "ord").select("file", "record")
    dealt.write.format(FORMAT).mode("append").save(folder)


def write_files(processed: DataFrame, folder: str, name: str = "output_name", data: str = "cleaned") -> None:
    """Each cleaned file under its name; rows without data are left out. Names must differ (see ``review.unique_names``), or the files of one name are joined."""
    rows = processed.where(F.col(data).isNotNull()).select(F.col(name).alias("file"), F.col(data).alias("record"))
    write_records(rows.withColumn("ord", F.lit(0)), folder)


def write_archives(records: DataFrame, folder: str) -> None:
    """One archive for each shard of ``files.zip_records``: ``folder``/<shard>.zip."""
    file = F.concat(F.col("shard").cast("string"), F.lit(".zip"))
    write_records(records.select(file.alias("file"), "ord", "record"), folder)
