"""Substring and suffix dedup against brute force."""

import hashlib
import os
import sys

from collections import Counter

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import SCHEMA, documents, with_repeats

from textmill.llm import queries, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(units, window):
    """For sequences in order: which positions are covered by a window that starts earlier."""
    seen, out = set(), []
    for u in units:
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            key = tuple(u[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append(gone)
    return out


def order(row):
    return (row[0] is None, row[0] or 0, row[1] is None, row[1] or "")


@pytest.mark.parametrize("repeats, bits", [(False, 64), (True, 64), (False, 1), (True, 3)])
def test_passages(spark, repeats, bits):
    """With hashes of 1 and 3 bits nearly all words collide, which the visits to the sources find out."""
    rows = sorted(with_repeats(documents()) if repeats else documents(), key=order)
    found = substring_dedup.dedup_passages(spark.createDataFrame(rows, SCHEMA), bits=bits).collect()
    assert found[0].__fields__[: len(rows[0])] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert found[0].__fields__[-2:] == ["n_words_", "n_removed"]  # n_words was taken
    words = [(r[1] or "").split() for r in rows]
    want = sorted((r[0] is None, r[0] or 0, None if r[1] is None else " ".join(w for w, x in zip(u, g) if not x), len(u), sum(g)) for r, u, g in zip(rows, words, brute(words, 20)))
    key = lambda t: (t[0], t[1], t[2] is None, t[2] or "", t[3:])
    assert sorted(((r[0] is None, r[0] or 0, r["text"], r["n_words_"], r["n_removed"]) for r in found), key=key) == sorted(want, key=key)


def passages(spark, rows, **options):
    found = substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options).collect()
    words = [r[1].split() for r in rows]
    want = {r[0]: " ".join(w for w, x in zip(u, g) if not x) for r, u, g in zip(rows, words, brute(words, 20))}
    assert {r.doc_id: r.text for r in found} == want


def test_one_gram_in_every_row(spark, monkeypatch):
    """The same ten words in all documents, in contexts that differ, agree for a while, or agree; few rows of them meet in a task."""
    import random

    rng = random.Random(5)
    gram = " ".join(f"g{i}" for i in range(10))
    sides = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(30)) for _ in range(12)]
    rows = [(i, f"{rng.choice(sides)} {gram} {rng.choice(sides)} {i}") for i in range(300)]
    from textmill.llm import windows

    seen = []
    for batch in windows.path_finder("words", 20, 10)(iter([pa.RecordBatch.from_pydict({"doc": [r[0] for r in rows], "text": [r[1] for r in rows]})])):
        seen += [(r["gram"], r["state"]) for r in batch.to_pylist()]
    plain = Counter(g for g, s in seen if s == windows.PLAIN)
    assert max(plain.values()) == windows.GRAM_PATHS and any(s == windows.PASSED for _, s in seen)
    passages(spark, rows)


def test_long_copies_are_one_span(spark):
    from textmill.llm import windows

    body = " ".join(f"w{i % 977}x{i}" for i in range(3000))
    rows = [(i, f"begin {i} {body} end {i}") for i in range(6)] + [(9, " ".join(body.split()[500:900]))]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        spans = substring_dedup.compacted(windows.marked_paths(texts, "words", 20, 10), 20).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    # the runs at the ends of the body differ; all between is one span a document
    assert sorted((r.doc, r.source, r.source_first - r.first) for r in spans) == [*((i, 0, 0) for i in range(1, 6)), (9, 0, 502)]
    assert all(r.n > (360 if r.doc == 9 else 2960) for r in spans)
    passages(spark, rows)


@pytest.mark.parametrize("repeats", [False, True])
def test_bytes(spark, repeats):
    rows = sorted(with_repeats(documents(2)) if repeats else documents(2), key=order)
    found = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    units = [(r[1] or "").encode() for r in rows]
    want = []
    for r, u, g in zip(rows, units, brute(units, 100)):
        spans = sum(x and (i == 0 or not g[i - 1]) for i, x in enumerate(g))
        want.append((r[0] is None, r[0] or 0, bytes(b for b, x in zip(u, g) if not x), len(u), sum(g), spans))
    assert found[0].__fields__[-4:] == ["kept_", "n_bytes", "n_removed", "n_spans"]
    assert sorted((r[0] is None, r[0] or 0, bytes(r["kept_"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found) == sorted(want)


@pytest.mark.parametrize("most", [4096, 5])
def test_one_route_in_every_row(spark, monkeypatch, most):
    """The same 90 bytes in all documents, between sides that differ, or agree for some bytes: one route, of more pieces than a shard may have."""
    import random

    monkeypatch.setattr(suffix_dedup, "ROUTE_PIECES", most)
    rng = random.Random(8)
    core = "".join(rng.choice("abcdefghij") for _ in range(90))
    sides = ["".join(rng.choice("klmnop") for _ in range(12)) for _ in range(9)]
    rows = [(i, f"{i}{rng.choice(sides)}{core}{rng.choice(sides)}{i}") for i in range(200)]
    found = {r.doc_id: r for r in suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    for (i, text), gone in zip(rows, brute([r[1].encode() for r in rows], 100)):
        assert bytes(found[i]["kept"]) == bytes(b for b, x in zip(text.encode(), gone) if not x)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.dedup_passages(empty).count() == 0
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_queries_on_the_whole_table(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for name, units, window, join in (("op5_substring_dedup", [t.encode().split() for _, t in docs], 20, b" ".join), ("op2_suffix_dedup", [t.encode() for _, t in docs], 100, bytes)):
        found = {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}
        assert len(found) == len(docs)
        for (i, _), u, g in zip(docs, units, brute(units, window)):
            assert (found[i].n_removed, found[i].kept_sha256) == (sum(g), hashlib.sha256(join(x for x, y in zip(u, g) if not y)).hexdigest())
