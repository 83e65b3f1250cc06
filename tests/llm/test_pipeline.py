"""The pipeline's stages against brute force, on the whole small table."""

import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import documents, with_repeats
from test_dedup import brute
from test_search import groups
from test_text_operators import word_list

import corpus_pipeline
from textmill.llm import langid, simhash

SF = "/root/testdata/sf0.001"


def test_run_matches_stage_by_stage_brute_force(spark):
    rows = sorted((r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(table, langid.train(table.filter(~langid.held_out())), ambiguous=corpus_pipeline.EVEN_HALVES).collect()
    sure = {r.doc_id for r in found if r.lang_pred != "und" and not r.lang_ambiguous}
    rows = [r for r in rows if r[0] in sure]
    group = groups([t for _, t, _ in rows], simhash.MOST)[0]
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    words = [t.encode().split() for _, t, _ in rows]
    rows = [(i, b" ".join(w for w, x in zip(u, g) if not x).decode(), s) for (i, _, s), u, g in zip(rows, words, brute(words, 20))]
    windows = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word_list(item.text)
        windows |= {tuple(w[p : p + 10]) for p in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = []
    for r in rows:
        w = word_list(r[1])
        if not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1)):
            clean.append(r)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {r[0] for r in clean}
    total = {}
    for i, text, source in clean:
        r = got[i]
        assert hashlib.md5(r.text.encode()).digest() == hashlib.md5(text.encode()).digest() and r.n_chars == len(text)
        assert r["size"] == len(text.split()) and r.taken <= 2 * r["size"]
        total.setdefault(source, [0, 0, r.target])
        total[source][0] += r["size"]
        total[source][1] += r.taken
    for size, taken, target in total.values():
        assert abs(taken - target) <= 128 + 0.02 * target and target <= 2 * size + 1e-6


@pytest.mark.parametrize("rows", [[], documents(9, 20), with_repeats(documents(9, 20))])
def test_stages_take_awkward_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([r[:5] for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() <= len(rows) and (not rows or docs.count())


def test_stages_keep_columns_with_clashing_names(spark):
    names = ["taken", "size", "source_size", "target", "_key", "_id", "id", "n_words", "n_hit", "items", "spans", "lang_pred", "lang_score", "lang_ambiguous", "_name", "part", "asked"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(*r[:5], *(f"{n}-{r[0]}" for n in names)) for r in with_repeats(documents(9, 20))]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r["_key"]) for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns[: 5 + len(names)] == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() and {(r.doc_id, r["_key"]) for r in docs.collect()} <= before and all(r[n] == f"{n}-{r.doc_id}" for r in docs.collect() for n in names), name
    assert docs.columns[-4:] == ["size_", "source_size_", "target_", "taken_"]


def test_folders(spark):
    import os

    from textmill.llm.common import discard, shared_folder, written

    table = written(spark.range(5))
    assert table.count() == 5 and shared_folder(spark) == shared_folder(spark)
    discard(table)
    assert not os.path.exists(table._written)
