"""Every query with an oracle, against DuckDB on the smallest tables."""

import duckdb
import pytest

from partwise.plans import queries
from partwise.plans.process import remove_metadata
from partwise.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranges_are_cut_with_one_walk(spark):
    """Files are built twice and walked once: contents and ranges meet in one join."""
    plan = QUERIES["q_svg_kept"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3


def test_every_document_has_data_addresses(spark):
    """Of q_svg_data_uris no half of the documents is left out: two rows for each."""
    got = QUERIES["q_svg_data_uris"](spark, SF).groupBy("doc_id").count().collect()
    assert len(got) == 200 and {r["count"] for r in got} == {2}


def test_packaged_files_are_read_once(spark):
    """Files are built and walked for their own entries, for packaged images and for data addresses, and no image twice."""
    plan = QUERIES["q_extract_all"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 12


def test_cleaned_files_are_proved(spark, monkeypatch):
    """Of q_clean: types come from the bytes, and a TIFF whose text lies over its header loses its type or its directory with it."""
    tiff = lambda at, n: b"II*\0\x08\0\0\0\1\0\x0e\1\2\0" + bytes([n, 0, 0, 0, at]) + bytes(7)
    rows = [(0, "tiff", tiff(0, 8)), (1, "tiff", tiff(4, 5)), (2, "tiff", tiff(0, 1)), (3, "png", b"\xff\xd8\xff\xfe\0\4hi\xff\xd9"), (4, "tiff", b"II*\0")]
    files = spark.createDataFrame(rows, "doc_id long, file_type string, content binary")
    monkeypatch.setattr(queries, "_files", lambda *_: files)
    got = QUERIES["q_clean"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, "tiff", None, None), (1, "tiff", None, None), (2, "tiff", 26, 0), (3, "jpeg", 4, 6), (4, "tiff", None, None)]
    errors = {r["doc_id"]: r["error"] for r in remove_metadata(files.select("doc_id", "content"), "doc_id").collect()}
    assert errors == {
        0: "Cleaned file type changed from tiff to unknown", 1: "Cleaned file failed validation: TIFF IFD contains too many entries", 2: None, 3: None, 4: "File too small",
    }
