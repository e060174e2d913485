"""The pipeline: every stage on rows of every kind, on empty tables, and against brute force on a small corpus."""

import random

import pytest

import corpus_pipeline
from partwise.llm import bpe, jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long, base string, row long"
rng = random.Random(21)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]


def _text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, _text(60, i), "en", "ab"[i % 2], 0, "kept", i) for i in range(60)]
    rows += [(100 + i, _text(60, i) + " tail", "en", "a", 0, "kept", 0) for i in range(5)]
    rows += [(3, _text(60, 3), "en", "b", 0, "kept", 0), (None, _text(50, 900), None, None, 0, None, None), (200, None, "en", "a", 0, "kept", 0), (201, "", "en", "b", 0, "kept", 0)]
    rows += [(300, _text(30, 7000) + " password = hunter2hunter2", "en", "a", 0, "kept", 0), (301, "you stupid idiot. " * 9 + _text(10, 7001), "en", "a", 0, "kept", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_run_equals_the_stages_and_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        own = stage(spark, own, folder)
        assert own.columns == docs.columns, name
    kept = own.collect()
    t = jaccard.Threshold(5, 80, 100)
    sets = [jaccard.shingles(r["text"], 5) for r in kept]
    assert not any(len(a) and len(b) and t.linked(len(set(a.tolist()) & set(b.tolist())), len(a), len(b)) for k, a in enumerate(sets) for b in sets[:k])
    assert len(kept) >= 60 and {200, 201, 300} <= {r["doc_id"] for r in kept} and None in {r["doc_id"] for r in kept}
    clean = corpus_pipeline.hide_secrets(spark, own, folder).collect()
    assert [r["text"].endswith("[SECRET]") and r["n_chars"] == len(r["text"]) for r in clean if r["doc_id"] == 300] == [True]
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in kept} and len(out) > 40
    text = {r["doc_id"]: r["text"] for r in clean}
    vocabulary = bpe.Vocabulary()
    for r in out[:20]:
        assert r["ids"] == bpe.encode_texts([text[r["doc_id"]] or ""], vocabulary)[0].tolist()


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        docs = out if name != "bpe" else docs


def test_toxic_rows_go_by_the_grammar(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    assert 301 not in left and {300, 200, 201, None} <= left
