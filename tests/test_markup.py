"""SVG and XML: elements by depth, ranges, and texts that no reader should meet."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from partwise.functions.detect import detect_file_type
from partwise.operators import ranges, xml
from partwise.operators.clean import clean
from partwise.operators.entries import entries
from partwise.operators.walk import walk
from partwise.walkers.markup import MOST_BYTES, Markup, svg


def kinds(text, *wanted):
    return [(p.kind, p.offset, p.offset + p.size) for p in svg(text, []) if p.kind in wanted]


def slow_tag_end(b, start):
    quote = None
    for pos in range(start + 1, len(b)):
        c = b[pos : pos + 1]
        if quote:
            quote = None if c == quote else quote
        elif c in (b"'", b'"'):
            quote = c
        elif c == b">":
            return pos + 1
    return -1


def slow_elements(b, names):
    """Elements by counting depth from each opening tag."""
    marks = Markup(b)
    tags = list(marks.tags())
    out, past = [], 0
    for k, t in enumerate(tags):
        if t.closing or t.local not in names or t.start < past:
            continue
        past, depth = t.end, 1
        if not t.empty:
            for u in tags[k + 1 :]:
                if u.local == t.local:
                    depth += -1 if u.closing else not u.empty
                if not depth:
                    past = u.end
                    break
        out.append((t.start, t.end, past))
    return out


def test_tags_and_elements_equal_plain_loops():
    rng = random.Random(4)
    pieces = [b"<desc>", b"</desc>", b"<a:desc x='1'>", b"<desc/>", b"<title>", b"</title >", b"<g a=\"<desc>\">", b"<!-- <desc> -->", b"<?x >?>", b"<", b">", b"'", b'"', b" x ", b"</", b"<TITLE\n>"]
    for _ in range(800):
        b = b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        marks = Markup(b)
        assert [slow_tag_end(b, k) for k in marks.opens] == marks.ends, b
        for names in ((b"desc",), (b"title", b"desc")):
            assert list(marks.elements(*names)) == slow_elements(b, names), b


def test_elements_in_one_another():
    assert kinds(b"<svg><desc>a<desc>b</desc>c</desc><desc>open<desc/></svg>", "TITLE") == [("TITLE", 5, 34), ("TITLE", 34, 40), ("TITLE", 44, 51)]
    assert kinds(b"<svg><script>a<b </title> <x> </script ><script>y</svg>", "ACTIVE", "CLOSING") == [("ACTIVE", 5, 40), ("ACTIVE", 40, 48), ("CLOSING", 30, 40)]
    assert [p.data for p in svg(b"<style a='>'>x</y></style>", []) if p.kind == "STYLE"] == [b"x</y></style>"]
    read = [(p.text, p.data) for p in svg(b"<a b='1' c d = \"2\" e=3/><z f='>' =g h='", []) if p.kind == "ATTRIBUTE"]
    assert read == [("b", b"1"), ("c", b""), ("d", b"2"), ("e", b"3")]
    faults = []
    list(svg(b"<svg>" + b" " * MOST_BYTES, faults))
    assert faults == ["SVG file is too large to inspect safely"]
    assert not [p for p in svg(b"<svg \xff><desc/>", []) if p.kind == "TITLE"]


HOSTILE = ["<", "<!", "<!DOCTYPE a b c ", "<svg ", '<a b="', "<a b='\"", "'", '"', "<desc>", "<!--", "<script>", "</", "plain words <! ", "<a:b:", "<?"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_texts_take_linear_time(piece):
    text = (piece * (400_000 // len(piece))).encode()
    began = time.time()
    assert len(list(svg(b"<svg>" + text, []))) >= 1 and len(list(svg(b"<svg>" + text + b">", []))) >= 1
    assert time.time() - began < 20


def test_hostile_texts_are_detected(spark):
    rows = [(k, p, 1_000_000 // len(p)) for k, p in enumerate(HOSTILE)]
    made = spark.createDataFrame(rows, "k int, piece string, n int").repartition(4).select("k", F.encode(F.repeat("piece", F.col("n")), "UTF-8").alias("content"))
    both = made.union(made.select(F.col("k") + 100, F.concat("content", F.lit(b">")))).union(made.select(F.col("k") + 200, F.concat(F.lit(b"<svg>"), "content")))
    got = {r["k"]: r["t"] for r in both.select("k", detect_file_type(F.col("content")).alias("t")).collect()}
    assert all(got[k + 200] == "svg" for k in range(len(HOSTILE)))
    assert {k for k in range(len(HOSTILE)) if got[k] == "svg"} == set() and {k for k in range(len(HOSTILE)) if got[k + 100] == "svg"} == {HOSTILE.index("<svg ")}


def test_svg_is_told_as_a_reader_would(spark):
    cases = {
        "<svg/>": 1, "<a title='<svg>'>": 1, "<!-- <svg> -->": 0, "<!-- open <svg>": 0, "<!d '<svg>'><b>": 0, "<!d 'open <svg>": 0, "x <y:SVG a='>'>": 1, "<svgs>": 0, "<svg": 0, "< svg >": 1, "</svg>": 0,
        "<a <svg>": 1, "<svg:a>": 0, "<b:c:svg >": 1, "": 0,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", (detect_file_type(F.encode("t", "UTF-8")) == "svg").alias("is")).collect()
    assert {r["t"]: int(r["is"]) for r in rows} == cases


def test_xml_texts_by_depth_and_size(spark):
    cases = {
        "<a><dc:title>x</dc:title></a>": ["x"], "<title>a<title>b</title>c</title><title/>": ["abc"], "<title>open<title>b</title>": ["b"], "<title>a<titles>b</titles></title>": ["ab"],
        "<title a='>'>v &amp; w<!-- n --></title >": ["v & w"], "<title><![CDATA[x]]></title><title>y</title>": ["y"], "<title>a<title/>b</title>": ["ab"], "</title><title> </title>": [],
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", F.transform(xml.texts_of(xml.bare(F.col("t")), "title"), lambda x: x["text"]).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == cases
    broken = spark.createDataFrame([(p, 300_000 // len(p)) for p in ("<title>", "<title a='", "<", "<a b=", "<!", "<title>x</title><title>", '"', "</title>")], "p string, n int").select(F.repeat("p", F.col("n")).alias("t"))
    began = time.time()
    read = broken.select(F.size(xml.texts_of(xml.bare(F.col("t")), "title")), xml.count_tags(xml.bare(F.col("t")), "title", "ins")).collect()
    assert len(read) == 8 and time.time() - began < 60


def test_ranges_equal_plain_loops(spark):
    rng = random.Random(9)
    files = [(k, bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 40, 200])))) for k in range(40)] + [(99, None)]
    cuts = []
    for k, b in files:
        for _ in range(rng.randint(0, 12)):
            s = rng.randint(0, len(b or b""))
            cuts.append((k, s, min(len(b or b""), s + rng.choice([0, 1, 3, 30, 90]))))
    cuts += cuts[:5]
    got = {r["path"]: r for r in ranges.kept(spark.createDataFrame(files, "path long, content binary"), spark.createDataFrame(cuts, "path long, start long, end long")).collect()}
    assert len(got) == len(files)
    for k, b in files:
        gone = {i for f, s, e in cuts if f == k for i in range(s, e)}
        left = bytes(c for i, c in enumerate(b or b"") if i not in gone)
        edges = sorted((s, e) for f, s, e in cuts if f == k and e > s)
        n, past = 0, -1
        for s, e in edges:
            n, past = n + (s > past), max(past, e)
        assert bytes(got[k]["kept"]) == left and got[k]["n_ranges"] == n and got[k]["removed_bytes"] == len(gone), k
    none = spark.createDataFrame([], "path long, start long, end long")
    assert ranges.kept(spark.createDataFrame([], "path long, content binary"), none).count() == 0
    whole = ranges.kept(spark.createDataFrame([(1, b"ab")], "path long, content binary"), none).first()
    assert (bytes(whole["kept"]), whole["n_ranges"], whole["removed_bytes"]) == (b"ab", 0, 0)


def test_svg_cleaning(spark):
    text = b"<?xml version='1.0'?><!-- c --><svg onload='x' a='1'><metadata><!-- d --><title/></metadata><g inkscape:label=\"k\" style='fill:url(#a)'/></script></svg>"
    files = spark.createDataFrame([("a", "svg", text), ("b", "svg", b"<svg href='data:image/png;base64,AA=='/>"), ("c", "svg", b"<svg/>")], "path string, file_type string, content binary")
    done = {r["path"]: r for r in clean(walk(files, content=True), again=True, types=("svg",)).collect()}
    assert bytes(done["a"]["cleaned"]) == b"<?xml version='1.0'?><svg a='1'><g style='fill:url(#a)'/></svg>" and bytes(done["c"]["cleaned"]) == b"<svg/>"
    assert done["b"]["error"] == "Cleaning of images in data addresses is not supported" and done["b"]["cleaned"] is None
    again = spark.createDataFrame([("a", "svg", bytes(done["a"]["cleaned"]))], files.schema)
    assert entries(walk(again), types=("svg",)).count() == 0
    assert not re.search(rb"onload|inkscape|<!--|metadata", bytes(done["a"]["cleaned"]))


def test_values_are_told_once(spark):
    """an expression that stood in the plan many times was told as often for each row."""
    from partwise.functions.text import decode_entities, shortened, trimmed
    from partwise.operators import documents
    from partwise.walkers.part import PARTS

    plan = lambda c: spark.sql(f"SELECT '' AS t, CAST(NULL AS {PARTS}) AS parts").select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan(shortened(trimmed(decode_entities(F.regexp_replace("t", "a", ""))), 180)).count("regexp_replace") == 1
    assert plan(documents.epub_entries(F.col("parts"))).count("container.xml") == 1


def test_texts_of_names_that_open_a_tag(spark):
    """Only such names are searched, whatever their prefix; names in texts, values and closing tags are none."""
    cases = {
        "<a:b:title>x &amp; <b>y</b></a:b:title><subject>z</subject>": [("title", "x & y"), ("subject", "z")], "<title/><titles>x</titles>": [], "<a title='title'>:title </a>": [],
        "<title\n>1</title><x><title>2</title></x>": [("title", "1"), ("title", "2")], "title </title> <!-- <title>x</title> --><![CDATA[<title>y</title>]]><? <title>z</title> ?>": [], "no mark": [], "": [], None: None,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", xml.texts_of(xml.bare(F.col("t")), "title", "subject").alias("v")).collect()
    assert {r["t"]: r["v"] and [tuple(x) for x in r["v"]] or r["v"] for r in rows} == cases
