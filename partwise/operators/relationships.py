"""Relationships between the parts of a document: where each leads, and which go when parts are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import lowered, trimmed
from partwise.operators.documents import KINDS, members, names, removed_part
from partwise.operators.xml import _INSIDE, _PREFIX, attribute_of, attributes_in, bare

_TAG = rf"(?s)<{_PREFIX}Relationship(?=[\s/>])({_INSIDE})>"
_STACK = "array<string>"


def folded(path: Column, base: Column) -> Column:
    """A path with its dot segments folded from the folder ``base``, as a stack of names; null if it leads above the root.

    A path that begins with a slash counts from the root.
    """
    steps = lambda p: F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    start = F.when(F.startswith(path, F.lit("/")), F.array().cast(_STACK)).otherwise(F.filter(F.split(base, "/"), lambda x: x != ""))
    up = lambda s: F.when(F.size(s) > 0, F.slice(s, F.lit(1), F.size(s) - 1))
    return F.aggregate(steps(path), start, lambda s, x: F.when(x == "..", up(s)).otherwise(F.concat(s, F.array(x))))


def source_folder(part: Column) -> Column:
    """The folder that the targets of a relationship part count from; null if its name tells none."""
    inner = F.regexp_extract(part, r"(?s)^(.*)/_rels/", 1)
    return F.when(part == "_rels/.rels", F.lit("")).when(F.contains(part, F.lit("/_rels/")), inner)


def target_part(part: Column, target: Column) -> Column:
    """The part that a target of a relationship part names, in lower case; null for none."""
    path = trimmed(F.replace(F.split_part(target, F.lit("#"), F.lit(1)), F.lit("\\"), F.lit("/")))
    return F.when(path != "", lowered(F.array_join(folded(path, source_folder(part)), "/")))


def relationships(walked: DataFrame, key: str = "path") -> DataFrame:
    """(key, part, ord, target, external, resolved, present, dropped) of the relationships of walked documents.

    ``resolved`` is the part that an internal target names, null if it is empty
    or leads above the root; ``present`` whether the document has it, ``dropped``
    whether cleaning removes the relationship because it removes that part. A
    missing target is empty. Parts that are no UTF-8 have none.
    """
    own = walked.where(F.col("file_type").isin(*KINDS))
    rels = F.filter(members(F.col("parts")), lambda m: F.endswith(m["text"], F.lit(".rels")))
    low = F.transform(names(F.col("parts")), lowered)
    rows = own.select(key, "file_type", low.alias("names"), F.explode(rels).alias("m"))
    heads = F.regexp_extract_all(bare(F.try_validate_utf8(F.col("m.data").cast("string"))), F.lit(_TAG), F.lit(1))
    tags = rows.select(key, "file_type", "names", F.col("m.text").alias("part"), F.posexplode(F.transform(heads, attributes_in)).alias("ord", "a"))
    value = lambda n: F.coalesce(attribute_of(F.col("a"), n), F.lit(""))
    told = tags.select(key, "file_type", "names", "part", "ord", value("Target").alias("target"), (lowered(value("TargetMode")) == "external").alias("external"))
    led = told.withColumn("resolved", F.when(~F.col("external"), target_part(F.col("part"), F.col("target"))))
    gone = F.coalesce(removed_part(F.col("file_type"), F.col("resolved")), F.lit(False)) & F.col("resolved").isNotNull()
    return led.select(key, "part", "ord", "target", "external", "resolved", F.coalesce(F.array_contains("names", F.col("resolved")), F.lit(False)).alias("present"), gone.alias("dropped"))
