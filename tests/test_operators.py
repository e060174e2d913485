"""Edge cases of the operators on hand-made bytes."""

import zlib

import io
import random
import zipfile

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partwise.functions import scalars, text
from partwise.functions.detect import detect_file_type
from partwise.operators import review
from partwise.operators.clean import clean
from partwise.operators.entries import entries
from partwise.operators.walk import BATCH, LEGACY, parts_of, walk
from partwise.plans.process import analyze, process, report, version
from partwise.sources import fixtures
from partwise.sources.files import read_files, stream_files, zip_records
from partwise.sources.sink import write_archives
from partwise.streaming.process import clean_stream
from partwise.walkers import WALKERS
from partwise.walkers.audio import page_crc, tails


def one(spark, file_type, content):
    return walk(spark.createDataFrame([("f", file_type, content)], "path string, file_type string, content binary"), content=True)


def told(spark, file_type, content):
    return [(e["category"], e["name"], e["value"]) for e in entries(one(spark, file_type, content), types=(file_type,)).orderBy("ord").collect()]


def cleaned(spark, file_type, content):
    r = clean(one(spark, file_type, content)).first()
    return r["error"] or bytes(r["cleaned"])


def chunk(kind, body):
    return len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)


def riff(form, *chunks):
    body = form + b"".join(k + len(d).to_bytes(4, "little") + d + bytes(len(d) & 1) for k, d in chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


PNG = b"\x89PNG\r\n\x1a\n"
HEAD, DATA, END = chunk(b"IHDR", bytes(13)), chunk(b"IDAT", b"x"), chunk(b"IEND", b"")


RULES = [
    ("jpeg", b"\xff\xd8\xff", "File too small"), ("jpeg", b"\xff\xd8\xff\xe0", "Truncated JPEG segment"), ("jpeg", b"\xff\xd8\xff\xe0\0\1\0", "Invalid segment length"), ("jpeg", b"nojpeg", "Not a valid JPEG file"),
    ("png", b"no", "Not a valid PNG file"), ("png", PNG + chunk(b"IDAT", b""), "PNG missing IHDR chunk"), ("png", PNG + chunk(b"IHDR", b"") + END, "Invalid PNG IHDR chunk"), ("png", PNG + HEAD + HEAD + DATA + END, "Duplicate PNG IHDR chunk"),
    ("png", PNG + HEAD + chunk(b"ABcd", b"") + DATA + END, "Unsupported critical PNG ABcd chunk"), ("png", PNG + HEAD + END, "PNG missing IDAT chunk"), ("png", PNG + HEAD + DATA + chunk(b"tEXt", b"a") + DATA + END, "PNG IDAT chunks must be consecutive"),
    ("png", PNG + HEAD + DATA + chunk(b"PLTE", b"") + END, "PNG PLTE chunk after IDAT"), ("png", PNG + HEAD + chunk(b"PLTE", b"") * 2 + DATA + END, "Duplicate PNG PLTE chunk"), ("png", PNG + HEAD + DATA + chunk(b"IEND", b"x"), "Invalid PNG IEND chunk"),
    ("png", PNG + HEAD + chunk(b"a1cd", b"") + DATA + END, "Invalid PNG chunk type"), ("png", PNG + HEAD + DATA[:-1] + b"\0" + END, "PNG CRC mismatch in IDAT chunk"), ("png", PNG + HEAD + b"\xff" * 12, "Invalid chunk length"), ("png", PNG + HEAD + DATA, "PNG missing IEND chunk"),
    ("webp", riff(b"WEBP", (b"EXIF", b"a")), "WebP missing image data chunk"), ("webp", riff(b"WEBP", (b"VP8 ", b"a"))[:-1], "Truncated WebP RIFF data"), ("webp", b"RIFF\3\0\0\0WEBP", "Invalid WebP RIFF size"),
    ("webp", b"RIFF\x10\0\0\0WEBPVP8 \x09\0\0\0abcd", "Invalid WebP chunk length"), ("wav", riff(b"WAVE", (b"fmt ", b"ab")), "WAV missing fmt or data chunk"), ("wav", None, "Not a valid WAV file"), ("wav", riff(b"WAVE", (b"fmt ", b""), (b"data", b""))[:4] + b"\x16\0\0\0" + riff(b"WAVE", (b"fmt ", b""), (b"data", b""))[8:] + b"ab", "Invalid WAV chunk length"),
    ("gif", b"", "Not a valid GIF file"), ("gif", b"GIF89a" + bytes(7), "GIF missing trailer"), ("gif", b"GIF89a" + bytes(7) + b"\1", "Invalid GIF block"), ("gif", b"GIF89a" + bytes(7) + b"\x2c", "Invalid GIF image block"), ("gif", b"GIF89a" + bytes(7) + b"\x21\xf9\1\0\1", "Invalid GIF extension block"),
    ("flac", b"fLaC\0\0\0\2ab", "FLAC missing STREAMINFO block"), ("flac", b"nope", "Not a valid FLAC file"), ("flac", b"fLaC\xff\0\0\0", "Invalid FLAC metadata block type"), ("flac", b"fLaC\x80\0\0\x22" + bytes(34), "FLAC missing audio frames"), ("flac", b"fLaC" + b"\0\0\0\x22" + bytes(34) + b"\1\0\0\0" * 1024, "FLAC file contains too many metadata blocks"),
    ("mp3", b"", "File too small"), ("mp3", b"abc", "MP3 missing MPEG audio frames"), ("ogg", b"OggS", "Truncated OGG page"), ("ogg", b"", "Not a valid OGG file"), ("ogg", b"x" * 30, "Invalid OGG page header"), ("ogg", b"OggS" + bytes(23), "OGG page checksum mismatch"),
    ("tiff", b"II*\0", "File too small"), ("tiff", b"XX*\0\0\0\0\0", "Not a valid TIFF file"), ("tiff", b"II\x2b\0\x08\0\0\0\0\0\0\0\0\0", "Not a classic TIFF file"), ("tiff", b"II*\0\x08\0\0\0\xff\xff", "TIFF IFD contains too many entries"),
    ("tiff", b"II*\0\x08\0\0\0\1\0", "Invalid TIFF IFD"), ("tiff", b"II*\0\x08\0\0\0\1\0" + b"\0\1\x63\0\1\0\0\0" + bytes(8), "Unsupported TIFF field type"), ("tiff", b"II*\0\x08\0\0\0\1\0" + b"\0\1\2\0\xff\0\0\0\xff\xff\0\0" + bytes(4), "Invalid TIFF field offset"),
    ("mp4", b"\0\0", "Truncated ISO-BMFF box"), ("mp4", b"\0\0\0\x09free", "Invalid ISO-BMFF box size"), ("mp4", b"\0\0\0\x08free" * 20_001, "ISO-BMFF file contains too many boxes"),
    ("zip", b"PK\5\6", "Unsupported file type"), ("pdf", b"%PDF", "Unsupported file type"),
]


def test_each_rule_has_its_error(spark):
    rows = [(k, *r[:2]) for k, r in enumerate(RULES)]
    files = spark.createDataFrame(rows, "path long, file_type string, content binary")
    got = {r["path"]: (r["error"], r["cleaned"]) for r in clean(walk(files, content=True)).collect()}
    for k, (_, _, error) in enumerate(RULES):
        assert got[k] == (error, None), RULES[k]


def test_reading_goes_on_past_damage_that_only_rules_forbid(spark):
    body = PNG + HEAD + chunk(b"tEXt", b"a\0b")[:-1] + b"\0" + chunk(b"tEXt", b"c\0d") + DATA + END
    assert told(spark, "png", body) == [("Text", "a", "b"), ("Text", "c", "d")]
    assert told(spark, "wav", riff(b"WAVE", (b"fmt ", b""), (b"junk", b"abc")) + b"x") == [("Other", "junk", "3 bytes"), ("Trailing", "Trailing Data", "1 bytes")]


def test_jpeg_scan_with_stuffing_and_fill(spark):
    body = b"\xff\xd8\xff\xff\xe2\x00\x0eICC_PROFILE\x00\xff\xe2\x00\x04ab\xff\xda\x00\x02\x01\xff\x00\xff\xd0\x02\xff\xd9junk"
    assert cleaned(spark, "jpeg", body) == b"\xff\xd8\xff\xe2\x00\x0eICC_PROFILE\x00\xff\xda\x00\x02\x01\xff\x00\xff\xd0\x02\xff\xd9"
    assert told(spark, "jpeg", body) == [("APP2", "APP2 Segment", "2 bytes")]


def test_jpeg_keeps_its_orientation_and_tells_it_no_more(spark):
    body = fixtures.jpeg(5, "text")
    once = cleaned(spark, "jpeg", body)
    assert b"\x01\x12\0\3\0\0\0\1\0\6" in once and told(spark, "jpeg", once) == [] and cleaned(spark, "jpeg", once) == once
    assert b"Exif" not in cleaned(spark, "jpeg", fixtures.jpeg(8, "text"))


def test_workers_get_few_bytes_at_a_time(spark):
    """Batches follow bytes, not rows: the files of many rows would fill a worker."""
    docs = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('text ', 8000)").alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    got = walk(fixtures.files(docs, "png"), "doc_id", content=True).mapInArrow(sizes, "n long").collect()
    assert len(got) > 4 and max(r["n"] for r in got) < 2 * BATCH


def test_tag_that_holds_the_letters_of_another():
    """128 bytes from the end of an APEv2 tag of 131 bytes stands TAG, of APETAGEX."""
    for text in (b"x" * 67, b"x" * 29 + b"TAG" + b"x" * 93):
        for behind in (b"", fixtures.id3v1(b"old")):
            for ahead in (b"", fixtures.lyrics(b"la")):
                found = tails(b"\xff\xfb\x90\x64sound" + ahead + fixtures.ape(text) + behind)
                assert [(p.kind, p.size) for p in found] == [("TAIL:ID3v1", 128)] * bool(behind) + [("TAIL:APEv2", 64 + len(text))] + [("TAIL:Lyrics3", 28)] * bool(ahead)


def test_cleaning_takes_a_whole_tag_of_131_bytes(spark):
    """Of q_clean, q_process and q_bytes_by_type: what an APEv2 tag of that size leaves is no ID3v1 tag."""
    t = "x" * 67
    assert cleaned(spark, "mp3", fixtures.mp3(6, t)) == b"\xff\xfb\x90\x64" + t.encode()
    assert cleaned(spark, "flac", fixtures.flac(10, t)).endswith(b"\xff\xf8" + t.encode())


def test_tags_behind_the_sound_begin_behind_what_leads_it(spark):
    """TAG in a comment 128 bytes from the end of a FLAC file, or in the tag before an MP3's sound, is no ID3v1 tag."""
    t = "x" * 9 + "TAG" + "x" * 6
    body = fixtures.flac(1, t)
    song = fixtures.id3((b"TIT2", b"\3TAG" + b"y" * 112)) + b"\xff\xfb\x90"
    assert body[-128:-125] == song[-128:-125] == b"TAG"
    assert cleaned(spark, "flac", body).endswith(b"\xff\xf8" + t.encode())
    assert cleaned(spark, "mp3", song) == b"\xff\xfb\x90"


def test_flac_behind_a_tag_and_before_tails(spark):
    body = fixtures.id3((b"TPE1", b"\0me")) + b"fLaC\x80\0\0\x22" + bytes(34) + b"\xff\xf8sound" + fixtures.lyrics(b"la") + fixtures.ape(b"x") + fixtures.id3v1(b"old")
    assert [n for _, n, _ in told(spark, "flac", body)] == ["ID3v2 tag prepended to FLAC", "Artist", "ID3v1 tag", "Title", "Artist", "Year", "APEv2 tag", "Lyrics3 tag"]
    assert cleaned(spark, "flac", body) == b"fLaC\x80\0\0\x22" + bytes(34) + b"\xff\xf8sound"
    r = process(spark.createDataFrame([("f", body)], "path string, content binary")).first()
    assert (r["status"], r["remaining"], r["file_type"]) == ("done", 0, "flac")


def test_cleaned_files_are_stable_and_tell_nothing(spark):
    rows = [(f"{t} {i} {len(x)}", build(i, x)) for t, build in fixtures.BUILD.items() if t in fixtures.TYPES for i in (0, 1, 3) for x in ("", "héllo wörld " * 300)]
    first = process(spark.createDataFrame(rows, "path string, content binary"))
    again = process(first.select("path", F.col("cleaned").alias("content")))
    got = first.select("path", "file_type", "status", "remaining", "cleaned", "error").join(again.select("path", F.col("cleaned").alias("twice"), F.col("removed_bytes").alias("more")), "path").collect()
    assert len(got) == len(rows)
    for r in got:
        odd = r["path"].startswith(("heic 1", "heic 3"))
        assert r["error"] is None and r["status"] == ("warning" if odd else "done") and r["path"].startswith(r["file_type"]), r
        assert bytes(r["twice"]) == bytes(r["cleaned"]) and r["more"] == 0


def test_process_needs_no_exchange_and_two_passes(spark):
    plan = process(spark.createDataFrame([("f", b"x")], "path string, content binary"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 2 and "Join" not in plan


@pytest.mark.parametrize("kind", sorted(WALKERS))
def test_walkers_raise_nothing_but_damage(kind):
    r = random.Random(kind)
    builds = {"zip": fixtures.docx, "mov": fixtures.mp4, "heif": fixtures.heic} | fixtures.BUILD
    for i in range(60):
        b = bytearray(builds[kind](i, "some text " * 9))
        for _ in range(r.randrange(1, 6)):
            b[r.randrange(len(b))] = r.randrange(256)
        parts_of(kind, bytes(b[: r.randrange(len(b) + 1)] if i % 2 else b))


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(sorted(WALKERS)))
def test_walkers_take_any_bytes(content, kind):
    error, parts = parts_of(kind, content)
    assert error is None or error
    assert all(p.offset + max(0, p.size) <= len(content) or p.kind in ("EXTENT", "FAULT") for p in parts)


def test_page_checksum_equals_the_plain_loop():
    r = random.Random(3)
    page = bytes(r.randrange(256) for _ in range(400))
    crc = 0
    for x in page[:22] + bytes(4) + page[26:]:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    assert page_crc(page) == crc


def test_analysis_of_kinds_and_reports(spark):
    rows = [("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("b.docx", fixtures.docx(1, "t")), ("c.svg", b"<a/><s:SVG x=''/>"), ("d.zip", fixtures.other_document(4, "t")), ("e", None), ("f.epub", fixtures.other_document(3, "t"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: (r["file_type"], r["error"]) for r in analyze(files).collect()}
    assert got == {"a.doc": ("office-legacy", LEGACY), "b.docx": ("docx", None), "c.svg": ("svg", None), "d.zip": ("unknown", "Unsupported file type"), "e": ("unknown", "Unsupported file type"), "f.epub": ("epub", None)}
    shown = {r["path"]: (r["output_name"], r["message"]) for r in report(process(files), "path").collect()}
    assert shown["a.doc"] == ("a_clean.doc", LEGACY) and shown["d.zip"][1] == "This file type is not supported." and version()


def test_zip_members_are_checked(spark):
    good = fixtures.docx(2, "t")
    bad = good.replace(b"<Types/>", b"<Typed/>", 1)
    unsafe = io.BytesIO()
    with zipfile.ZipFile(unsafe, "w") as z:
        z.writestr("../a", "x")
    assert parts_of("zip", good)[0] is None and parts_of("zip", bad)[0] == "ZIP CRC mismatch in [Content_Types].xml"
    assert parts_of("zip", unsafe.getvalue()) == ("Unsafe ZIP entry name ../a", [])
    assert parts_of("zip", good[:-1])[0] == "Not a valid ZIP archive"


def test_text_functions(spark):
    cases = [("&amp;&lt;&#65;&#x42;&#xD800;&bad;&", "&<AB&bad;&"), ("&foo &amp; x", "&foo &amp; x"), ("&#99999999999999;a", "a"), ("", ""), (None, None)]
    got = spark.createDataFrame(cases, "t string, want string").select(text.decode_entities(F.col("t")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    css = [("\\75 rl(", "url("), ("a\\", "a"), ("\\g\\\\", "g\\"), ("\\00e9x", "éx"), ("plain", "plain")]
    got = spark.createDataFrame(css, "t string, want string").select(text.decode_css(F.col("t")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    b64 = [("aGk=", b"hi"), (" a G\nk ", b"hi"), ("aGk", b"hi"), ("a", b""), ("a*", None), ("", b""), ("aGk=zz*", b"hi")]
    got = spark.createDataFrame(b64, "t string, want binary").select(text.base64_decode(F.col("t")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    names = spark.createDataFrame([("a:B c&d\u00a0",)], "t string").select(text.local_name(F.col("t")), text.class_name(F.col("t")), text.escape_attribute(F.col("t"))).first()
    assert tuple(names) == ("B c&d\u00a0", "a-b-c-d-", "a:B c&amp;d&nbsp;")


def test_unique_names_equal_the_plain_loop(spark):
    r = random.Random(9)
    names = [r.choice(["a.txt", "A.TXT", "a-2.txt", "b", "B-2", "..", "con", "a-3.txt", "dir/a.txt"]) for _ in range(120)]
    rows = [(i % 2, i, n) for i, n in enumerate(names)]
    got = {x["o"]: x["output_name"] for x in review.unique_names(spark.createDataFrame(rows, "b long, o long, name string"), "b", "o", "name").collect()}
    safe = {x["n"]: x["s"] for x in spark.createDataFrame([(n,) for n in set(names)], "n string").select("n", scalars.sanitize_name(F.col("n")).alias("s")).collect()}
    for batch in (0, 1):
        used = set()
        for b, o, n in rows:
            if b != batch:
                continue
            base, dot, end = safe[n].rpartition(".")
            base, end = (base, dot + end) if base else (safe[n], "")
            candidate, k = base + end, 2
            while candidate.lower() in used:
                candidate, k = f"{base}-{k}{end}", k + 1
            used.add(candidate.lower())
            assert got[o] == candidate


def test_detection_order(spark):
    rows = [(b"\xff\xfe<", "mp3"), (b"ID3\x04\x00\x00\x00\x00\x00\x00fLaC", "flac"), (b"ID3\x03\x00\x00\x00\x00\x7f\x7f", "unknown"), (b"", "unknown"), (None, "unknown"), (b"%PDF", "pdf"), (b"\0\0\0\x14ftypmif1\0\0\0\0heic", "heic"), (b"\0\0\0\x18ftypdash\0\0\0\0avc1iso3", "unknown"), (b"\0\0\0\1ftyp\0\0\0\0\0\0\0\x1cM4A \0\0\0\0xxxx", "mp4"), (b"\0\0\0\0ftypqt  \0\0\0\0", "mov"), (b"<!-- <svg> --><p>", "unknown"), (b"\xef\xbb\xbf<?xml?><SVG/>", "svg"), (b"<svg \xff>", "unknown")]
    df = spark.createDataFrame(rows, "content binary, want string").withColumn("got", detect_file_type(F.col("content")))
    assert [r["got"] for r in df.collect()] == [w for _, w in rows]


def test_names_and_sizes(spark):
    df = spark.createDataFrame([("../secret.jpg", 0), ("CON", 1023), ("NUL.txt", 1024), ("..", 1 << 20), (None, 1 << 31), ("a.b.C", 1536)], "n string, s long")
    got = df.select(scalars.clean_name(F.col("n")), scalars.format_size(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("secret_clean.jpg", "0 B"), ("CON_file_clean", "1023.0 B"), ("NUL_file_clean.txt", "1.0 KB"), ("file_clean", "1.0 MB"), ("file_clean", "2.0 GB"), ("a.b_clean.C", "1.5 KB"),
    ]


def test_files_and_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.jpg").write_bytes(b"\xff\xd8\xff\xfe\x00\x04hi\xff\xd9")
    (source / "b.bin").write_bytes(b"\0" * 50)
    rows = {r["name"]: r for r in read_files(spark, str(source), most=40).collect()}
    assert rows["b.bin"]["content"] is None and rows["b.bin"]["error"] and rows["a.jpg"]["error"] is None
    clean_stream(stream_files(spark, str(source), most=40), str(out), str(tmp_path / "ck")).awaitTermination()
    got = {r["name"]: r for r in spark.read.parquet(str(out)).collect()}
    assert bytes(got["a.jpg"]["cleaned"]) == b"\xff\xd8\xff\xd9" and got["a.jpg"]["output_name"] == "a_clean.jpg"
    assert got["b.bin"]["cleaned"] is None and got["b.bin"]["error"].startswith("File exceeds the")


def test_zip_archives(spark, tmp_path):
    rows = [("x", "é.txt", b"abc"), ("x", "b.bin", bytes(1000)), ("y", "c", b""), ("x", "none", None)]
    write_archives(zip_records(spark.createDataFrame(rows, "shard string, output_name string, cleaned binary")), str(tmp_path))
    for shard in ("x", "y"):
        with zipfile.ZipFile(tmp_path / f"{shard}.zip") as z:
            assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: d for s, n, d in rows if s == shard and d is not None}
            assert z.infolist()[0].date_time == (1980, 1, 1, 0, 0, 0)


def test_flac_comment_with_broken_utf8_is_an_entry_not_a_failure(spark):
    text = b"ARTIST=a\xffb"
    comments = b"\x01\0\0\0v\x01\0\0\0" + bytes([len(text), 0, 0, 0]) + text
    content = b"fLaC\0\0\0\x22" + bytes(34) + b"\x84\0\0" + bytes([len(comments)]) + comments + b"\xff\xf8"
    assert [x[1:] for x in told(spark, "flac", content)][1:] == [("Encoder (vendor)", "v"), ("ARTIST", "a\ufffdb")]
