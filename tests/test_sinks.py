"""The sink with commit, the stream with proof, relationships, packaged files and damage by level."""

import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from partwise.operators import nested, relationships
from partwise.operators.clean import clean
from partwise.operators.walk import typed, walk
from partwise.plans.process import analyze, analyzed_entries
from partwise.sources import fixtures
from partwise.sources.files import stream_files, zip_records
from partwise.sources.sink import FileWriter, write_archives, write_files, write_records
from partwise.streaming.process import prove_stream

JPEG = b"\xff\xd8\xff\xfe\0\x08inside\xff\xd9"


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_files_show_when_the_job_is_done(spark, tmp_path):
    rows = [(f"f{k}.bin", bytes([k]) * 10 * k) for k in range(9)] + [("none", None)]
    processed = spark.createDataFrame(rows, "output_name string, cleaned binary").repartition(4)
    for _ in range(2):
        write_files(processed, str(tmp_path / "out"))
        assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == dict(rows[:9])
    broken = processed.withColumn("cleaned", F.when(F.col("output_name") == "f7.bin", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="lost"):
        write_files(broken, str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == dict(rows[:9])
    for name in ("../x", "a/b", "", None, ".writing-x", ".."):
        with pytest.raises(Exception, match="Not a name inside the folder"):
            write_records(spark.createDataFrame([(name, 0, b"x")], "file string, ord int, record binary"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 9


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    writer = FileWriter(str(tmp_path))
    first = writer.write(iter([{"file": "a", "record": b"1"}]))
    second = writer.write(iter([{"file": "a", "record": b"1"}, {"file": "b", "record": b""}]))
    assert first.files != second.files and [p.name[:9] for p in tmp_path.iterdir()] == [".writing-"]
    writer.commit([second, None])
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"a": b"1", "b": b""}
    again = FileWriter(str(tmp_path))
    with pytest.raises(ValueError, match="two tasks"):
        again.commit([again.write(iter([{"file": "a", "record": b"x"}])), again.write(iter([{"file": "a", "record": b"y"}]))])
    assert (tmp_path / "a").read_bytes() == b"1" and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(ValueError, match="do not come together"):
        again.write(iter([{"file": n, "record": b""} for n in "aba"]))


def test_archives_are_the_same_each_time(spark, tmp_path):
    rows = [(k % 3, f"n{k}.txt", b"x" * k) for k in range(30)]
    records = zip_records(spark.createDataFrame(rows, "shard int, output_name string, cleaned binary").repartition(5))
    made = []
    for _ in range(2):
        write_archives(records, str(tmp_path))
        made.append({p.name: p.read_bytes() for p in tmp_path.iterdir()})
    assert made[0] == made[1] and sorted(made[0]) == ["0.zip", "1.zip", "2.zip"]
    with zipfile.ZipFile(tmp_path / "1.zip") as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: d for s, n, d in rows if s == 1}


def test_stream_tells_each_file_once(spark, tmp_path):
    source, out, errors, ck = (tmp_path / n for n in ("in", "out", "errors", "ck"))
    source.mkdir()
    (source / "a.jpg").write_bytes(JPEG)
    (source / "b.bin").write_bytes(bytes(100))
    (source / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    for round_ in range(3):
        if round_ == 1:
            (source / "d.jpg").write_bytes(JPEG)
        prove_stream(stream_files(spark, str(source), most=60), str(out), str(errors), str(ck)).awaitTermination()
    got = {r["name"]: r for r in spark.read.parquet(str(out)).collect()}
    assert sorted(got) == ["a.jpg", "d.jpg"] and spark.read.parquet(str(out)).count() == 2
    assert all(bytes(r["cleaned"]) == b"\xff\xd8\xff\xd9" and (r["remaining"], r["removed_bytes"]) == (0, 10) for r in got.values())
    told = {r["name"]: (r["file_type"], r["error"]) for r in spark.read.parquet(str(errors)).collect()}
    assert sorted(told) == ["b.bin", "c.png"] and told["b.bin"][1].startswith("File exceeds the") and told["c.png"][0] == "png"


def test_paths_are_folded(spark):
    cases = {
        ("_rels/.rels", "word/a.xml"): "word/a.xml", ("w/_rels/d.rels", "../x/./y//Z"): "x/y/z", ("w/_rels/d.rels", "../../x"): None, ("w/_rels/d.rels", "/../x"): None, ("a.rels", "b"): None, ("a.rels", "/b"): "b",
        ("w/_rels/d.rels", ""): None, ("w/_rels/d.rels", "#f"): None, ("w/_rels/d.rels", "a/../../w/b"): "w/b", ("w/v/_rels/u/_rels/d.rels", "../b"): "w/v/_rels/b", ("w/_rels/d.rels", "..\\c"): "c", ("w/_rels/d.rels", "..\\..\\.."): None,
        ("_rels/.rels", ".."): None, ("w/_rels/d.rels", ".."): "",
    }
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "part string, target string, want string")
    got = rows.select("part", "target", relationships.target_part(F.col("part"), F.col("target")).alias("got")).collect()
    assert {(r["part"], r["target"]): r["got"] for r in got} == cases


def test_packaged_files_to_the_last(spark):
    address = "data:image/jpeg;base64," + base64.b64encode(JPEG).decode()
    inner = f"<svg><desc/><image href='{address}'/><image href='data:image/svg+xml;base64,PHN2Zy8+'/></svg>".encode()
    docx = packed({"[Content_Types].xml": "<T/>", "word/document.xml": "<a/>", "word/media/1.png": JPEG, "word/media/2.svg": inner, "word/media/3.gif": b"none", "word/media/4.JPG": b"\xff\xd8\xff\xd9"})
    files = spark.createDataFrame([("d", docx), ("s", inner), ("j", JPEG), ("n", None)], "path string, content binary")
    got = {}
    for r in analyzed_entries(files, types=("docx", "svg", "jpeg")).orderBy("ord").collect():
        got.setdefault(r["path"], []).append((r["category"], r["name"], r["value"]))
    inside = "Embedded image metadata"
    left = "1 data URI reference(s) preserved; the embedded content could not be verified or cleaned"
    desc, image = "1 present; removed during SVG cleaning", "1 metadata entries inside embedded jpeg image; removed during SVG cleaning"
    assert got["s"] == [("SVG metadata", "title/description elements", desc), (inside, "Embedded data URI image", image), ("Limited verification", "Embedded data URI content", left)]
    assert got["j"] == [("Comment", "Comment", "inside")] and "n" not in got
    two = "word/media/2.svg"
    assert got["d"] == [
        (inside, "word/media/1.png", "1 metadata entries inside packaged image; removed during cleaning"), (f"{inside}: Comment", "word/media/1.png: Comment", "inside"),
        (inside, two, "3 metadata entries inside packaged image; removed during cleaning"), (f"{inside}: SVG metadata", f"{two}: title/description elements", desc),
        (f"{inside}: {inside}", f"{two}: Embedded data URI image", image), ("Limited verification", f"{two}: Embedded data URI content", left),
        ("Limited verification", "Embedded package images", "1 packaged image(s) preserved without cleaning because the content could not be read as a supported image format"),
    ]
    none = spark.createDataFrame([], "path string, content binary")
    assert nested.all_entries(walk(typed(none)), types=("docx", "svg")).count() == 0


def test_damage_counts_where_it_matters(spark):
    rows = [("sound", fixtures.tiff(1, "t")), ("lost", fixtures.tiff_lost(1, "t")), ("first", fixtures.tiff(1, "t")[:20])]
    read = analyze(spark.createDataFrame(rows, "path string, content binary"), content=True)
    errors = {r["path"]: r["error"] for r in read.collect()}
    assert errors["sound"] is None and errors["lost"] is None and errors["first"]
    done = {r["path"]: (r["error"], r["cleaned"]) for r in clean(read, types=("tiff",)).collect()}
    assert done["sound"][1] is not None and done["lost"] == ("Unexpected end of TIFF file", None) and done["first"][1] is None
