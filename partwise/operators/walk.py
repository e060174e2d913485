"""Containers as arrays of parts.

One pass over the bytes of each file turns it into an array of parts; what the
parts mean, which ones stay and how they are joined again are expressions over
that array (see ``entries`` and ``clean``), so no file's bytes are shuffled.
Bytes of image and sound data never leave the pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from partwise.functions.detect import detect_file_type
from partwise.functions.text import bound
from partwise.operators.documents import KINDS, kind_of
from partwise.walkers import WALKERS, Damaged, Part
from partwise.walkers.part import PARTS

#: Bytes of Arrow data that a Python worker takes apart at a time, and bytes that Spark hands it at once.
SLICE, BATCH = 1 << 20, 4 << 20
_FIELDS = ("kind", "offset", "size", "n", "num", "sub", "told", "text", "data")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about SLICE bytes: Arrow counts rows, and files may be large."""
    for b in batches:
        step = max(1, int(b.num_rows * SLICE / max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def bounded(rows: DataFrame) -> DataFrame:
    """``rows``, whose session hands Python workers BATCH bytes at a time from here on (or one row): by its own measure, rows or 64 MB, a worker's memory would follow the input."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return rows


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(schema))


def parts_of(file_type: str | None, content: bytes | None) -> tuple[str | None, list[Part]]:
    """(error, parts) of one file; a damaged one keeps the parts before the damage."""
    if file_type not in WALKERS:
        return "Unsupported file type", []
    faults: list[str] = []
    out: list[Part] = []
    try:
        out.extend(WALKERS[file_type](content or b"", faults))
    except Damaged as e:
        faults.append(str(e))
    return (faults[0] if faults else None), out


def parts_array(found: list[list[Part]], kind: pa.DataType) -> pa.Array:
    """Arrow's list array of the parts of each file."""
    flat = [p for parts in found for p in parts]
    ends = [0]
    for parts in found:
        ends.append(ends[-1] + len(parts))
    struct = kind.value_type
    columns = [pa.array([k for parts in found for k in range(len(parts))], struct.field("ord").type)]
    columns += [pa.array([getattr(p, name) for p in flat], struct.field(name).type) for name in _FIELDS]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(struct)))


def walk(files: DataFrame, key: str = "path", content: bool = False) -> DataFrame:
    """(key, file_type, error, parts) from (key, file_type, content), with ``content`` if asked for.

    ``error`` is what breaks the format's rules first, null for a sound file;
    types without a walker have ``Unsupported file type``. A ZIP directory that
    is no document of a known kind becomes ``unknown``. Null content is an empty
    file.
    """
    kind = files.schema[key].dataType.simpleString()
    schema = arrow_schema(f"{key} {kind}, file_type string, {'content binary, ' if content else ''}error string, parts {PARTS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, types, contents = (batch.column(k) for k in range(3))
            found = [parts_of(t, c) for t, c in zip(types.to_pylist(), contents.to_pylist(), strict=True)]
            columns = [keys, types, *([contents] if content else []), pa.array([e for e, _ in found], pa.string()), parts_array([p for _, p in found], schema.field("parts").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    out = bounded(files.select(key, "file_type", "content")).mapInArrow(run, f"{key} {kind}, file_type string, {'content binary, ' if content else ''}error string, parts {PARTS}")
    document = F.when(F.col("file_type") == "zip", F.coalesce(kind_of(F.col("parts")), F.lit("unknown")))
    told = out.withColumn("file_type", F.coalesce(document, F.col("file_type")))
    unknown = F.col("file_type").eqNullSafe(F.lit("unknown"))
    return told.withColumn("error", F.when(unknown, F.lit("Unsupported file type")).otherwise(F.col("error"))).withColumn("parts", F.when(unknown, F.array().cast(PARTS)).otherwise(F.col("parts")))


def typed(files: DataFrame) -> DataFrame:
    """``files`` with ``file_type`` from the leading bytes; ZIP files are ``zip`` until ``walk`` has read their directory."""
    # Bound, as each of the many places that read the bytes would copy the whole file.
    return files.withColumn("file_type", bound(F.col("content"), detect_file_type))


def identify(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, file_type) with the kinds of ZIP documents told apart: only ZIP files are walked."""
    with_type = typed(files).select(key, "file_type", "content")
    is_zip = F.col("file_type") == "zip"
    return with_type.where(~is_zip).select(key, "file_type").union(walk(with_type.where(is_zip), key).select(key, "file_type"))


def legacy_office(file_type: Column, error: Column) -> Column:
    """The error of a file, with the fixed text for legacy Office files."""
    return F.when(file_type == "office-legacy", F.lit(LEGACY)).otherwise(error)


#: Fixed value: what is said of legacy Office files.
LEGACY = "Legacy binary Office files (.doc, .xls, .ppt) are not supported. Save the file as .docx, .xlsx, or .pptx first."
SUPPORTED = (*[t for t in WALKERS if t != "zip"], *KINDS)
