"""The whole pass: detect, take apart, list, clean, and list again as proof."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions.detect import detect_file_type
from partwise.functions.scalars import clean_name, friendly_error
from partwise.functions.text import bound
from partwise.operators.clean import JOIN, clean
from partwise.operators.entries import entry_rows
from partwise.operators.nested import all_entries
from partwise.operators.review import status
from partwise.operators.walk import legacy_office, typed, walk

__version__ = "1.0.0"


def version() -> str:
    """The version of the rules that this library applies."""
    return __version__


def analyze(files: DataFrame, key: str = "path", content: bool = False) -> DataFrame:
    """(key, file_type, error, parts) from (key, content)."""
    walked = walk(typed(files), key, content)
    return walked.withColumn("error", legacy_office(F.col("file_type"), F.col("error")))


def analyzed_entries(files: DataFrame, key: str = "path", types: Iterable[str] | None = None) -> DataFrame:
    """Entries of the files that are sound and of what they package, as an analysis shows them: a file with an error has none."""
    return all_entries(analyze(files, key).where("error is null"), key, types)


def type_stable(cleaned: DataFrame, key: str = "path") -> DataFrame:
    """``cleaned`` (see ``clean`` with ``again``) with ``error`` set where the cleaned bytes are of another type or break their format's rules."""
    seen = bound(F.col("cleaned"), detect_file_type)
    changed = bound(seen, lambda t: F.when(t != F.col("file_type"), F.concat(F.lit("Cleaned file type changed from "), "file_type", F.lit(" to "), t)))
    broken = F.when(F.col("again_error").isNotNull(), F.concat(F.lit("Cleaned file failed validation: "), "again_error"))
    return cleaned.withColumn("error", F.coalesce("error", F.when(F.col("cleaned").isNotNull(), F.coalesce(changed, broken))))


def remove_metadata(files: DataFrame, key: str = "path", types: Iterable[str] | None = None) -> DataFrame:
    """(key, file_type, error, cleaned, removed_bytes, parts) from (key, content): detected, checked, cleaned, and detected and read again as proof.

    A damaged file, and one whose cleaned bytes change type or no longer read,
    has an error and no cleaned bytes. ``parts`` are those of the cleaned bytes.
    Two passes over the bytes, and nothing is shuffled. ``types`` are the file
    types that can occur, all if not given: fewer plan faster.
    """
    proved = type_stable(clean(analyze(files, key, content=True), key, again=True, types=types), key)
    sound = F.col("error").isNull()
    return proved.select(key, "file_type", "error", *[F.when(sound, F.col(c)).alias(c) for c in ("cleaned", "removed_bytes")], "parts")


def process(files: DataFrame, key: str = "path", types: Iterable[str] | None = None) -> DataFrame:
    """(key, file_type, error, cleaned, removed_bytes, remaining, status): ``remove_metadata``, and what is left told.

    ``remaining`` counts the entries that the cleaned bytes still hold.
    """
    types = [t for t in JOIN if types is None or t in set(types)]
    left = F.when(F.col("error").isNotNull(), F.lit(0)).otherwise(F.size(entry_rows(types))).cast("long")
    out = remove_metadata(files, key, types).withColumn("remaining", left)
    return out.select(key, "file_type", "error", "cleaned", "removed_bytes", "remaining", status(F.col("error"), F.col("remaining")).alias("status"))


def report(processed: DataFrame, name: str = "name") -> DataFrame:
    """``processed`` with ``output_name`` and ``message``, as a reader sees them."""
    return processed.withColumn("output_name", clean_name(F.col(name))).withColumn("message", friendly_error(F.col("file_type"), F.col("error")))
