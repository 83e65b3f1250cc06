"""Near duplicates and nearest neighbours against brute force."""

import os
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import SCHEMA, documents, with_repeats

from textmill.llm import ann, queries, simhash
from textmill.llm import kernels as K
from textmill.llm.fingerprints import BITS, coordinates, distances, fingerprints

SF = "/root/testdata/sf0.001"


def prints_of(texts):
    data, offsets = K.buffers(pa.array(texts, pa.string()))
    return fingerprints(data, offsets)


def groups(texts, most):
    """Group (least index), links to other fingerprints, and copies, by comparing all."""
    prints, words = prints_of(texts)
    n = len(texts)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, copies = [0] * n, [0] * n
    for i in range(n):
        seen = set()
        for j in range(n):
            if not (words[i] and words[j]):
                copies[i] += i == j
                continue
            d = int(distances(prints[i : i + 1], prints[j : j + 1])[0])
            copies[i] += d == 0
            if d <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
                if d and tuple(prints[j]) not in seen:
                    seen.add(tuple(prints[j]))
                    links[i] += 1
    return [find(i) for i in range(n)], links, copies


@pytest.mark.parametrize("block", [4096, 8])
def test_near_duplicates_match_brute_force(spark, block):
    base = [r[1] for r in documents(4, 40)]
    edited = [None if t is None else " ".join(w for k, w in enumerate(t.split()) if k % 23 != 3) for t in base[:25]]
    texts = base + edited + [t for t in base if t and len(t) > 100][:3] * 3
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    found = {r["key"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string"), block=block).collect()}
    want = groups(texts, simhash.MOST)
    assert len(found) == len(texts)
    for i, (group, links, copies) in enumerate(zip(*want)):
        assert (found[i].group_id, found[i].n_links, found[i].n_copies) == (group, links, copies), i


def test_awkward_rows_keep_one_of_each(spark):
    rows = with_repeats(documents(3, 30))
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = [r.text for r in kept.collect()]
    filled = [t for t in texts if t and prints_of([t])[1][0]]
    assert len(filled) == len(set(filled)) and {t for r in rows if (t := r[1]) and prints_of([t])[1][0] and prints_of([t])[1][0] > 30} >= set(filled) - set(filled)
    assert texts.count(None) == sum(r[1] is None for r in rows)  # texts without a word are alone
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_level_of_strips_is_a_function_of_the_fingerprint():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, (500, BITS // 64)).astype(np.uint64)
    strips = simhash.Strips(500 * (1 << 19), 3, 1)
    assert strips.levels == [12, 12, 4]
    lists = strips.lists(coordinates(prints), 1)
    assert (lists == strips.lists(coordinates(prints), 1)).all() and (lists != strips.lists(coordinates(prints), 2)).any()
    assert (simhash.code(12).nearest >= 0).all() and (np.bincount(simhash.code(12).nearest) == 2048).all() and (np.bincount(simhash.code(4).nearest) == 8).all()


@pytest.mark.parametrize("rows, most, leaf", [(1 << 30, 40, 512), (5 << 30, 40, 512), (1 << 20, 90, 512), (1 << 20, 40, 1)])
def test_repetitions_meet_the_recall(rows, most, leaf):
    strips = simhash.plan(rows, most, 0.995, leaf)
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2, (4000, 256), np.uint8)
    b = a.copy()
    for x in b:
        x[rng.choice(256, most, replace=False)] ^= 1
    met = np.mean([(strips.lists(a, t) == strips.lists(b, t)).mean() for t in range(100, 140)])
    assert 1 - (1 - met) ** strips.repeats >= 0.99


def test_simhash_query_on_the_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    found = {r.doc_id: r for r in queries.op7_simhash(spark, SF).collect()}
    want = groups([t for _, t in docs], simhash.MOST)
    assert len(found) == len(docs)
    for (i, _), group, links, copies in zip(docs, *want):
        assert (found[i].class_id, found[i].n_links, found[i].n_copies) == (docs[group][0], links, copies)


def nearest(ids, vectors, query, k):
    score = vectors @ vectors[ids == query][0]
    keep = ids != query
    order = np.lexsort((ids[keep], -score[keep]))[:k]
    return [(int(i), float(s)) for i, s in zip(ids[keep][order], score[keep][order])]


def test_neighbours_with_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8)).round(2)
    vectors[50:90] = vectors[10]  # more copies than a result holds
    vectors *= rng.uniform(0.5, 2, (400, 1)).round(1)
    vectors[50:90] = vectors[10]
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    odd = [(1000, None, "x"), (1020, [], "x"), (1040, [0.0] * 8, "x"), (1060, [1.0, None] * 4, "x"), (1080, [float("nan")] * 8, "x"), (1100, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (1120, [1.0] * 3, "x")]
    table = spark.createDataFrame(rows + odd + rows[:2], "vec_id long, embedding array<double>, node string")
    found = ann.nearest(ann.index(table, k=20, shard=150), table.filter("vec_id % 10 = 0"), block_bytes=900).collect()
    ids, hits, total = np.arange(400), 0, 0
    for q in range(0, 400, 10):
        got = sorted((r["rank"], r["id"], r["score"]) for r in found if r["query_id"] == q)
        want = [w for w in nearest(ids, vectors, q, 22) if w[0] != q]
        assert [g[0] for g in got] == list(range(1, 21))
        mine = [g[1] for g in got]
        hits += len({w[0] for w in want[:20]} & set(mine))
        total += 20
        for _, i, s in got:
            assert abs(s - vectors[i] @ vectors[q]) < 1e-12
    assert hits / total > 0.9
    assert not [r for r in found if r["query_id"] >= 1000]
    empty = spark.createDataFrame([], table.schema)
    assert ann.nearest(ann.index(empty), empty).count() == 0


@pytest.mark.parametrize("tail", [1.0, 1e4])
def test_long_vectors_do_not_blur_the_others(tail):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) * rng.pareto(2.0, (3000, 1)).clip(0.1)
    x[7] *= tail
    q = rng.normal(size=(60, 24))
    edges, entry = ann.build(x)
    found = ann.search(ann.extended(x), edges, entry, q)
    score = q @ x.T
    want = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(set(w) & set(f)) / 20 for w, f in zip(want.tolist(), found.tolist())]) > 0.88


def test_a_third_of_equal_vectors_is_a_few_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 == 0 else [float(v) for v in rng.normal(size=3)]) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    graphs = ann.index(table, k=5).collect()
    assert sum(len(g.ids) // 8 for g in graphs) == 2000 + 6
    found = ann.nearest(ann.index(table, k=5), table.filter("vec_id IN (0, 3000, 33)"), k=5).orderBy("query_id", "rank").collect()
    assert [r.query_id for r in found] == [0] * 5 + [33] * 5 and all(r.id != r.query_id for r in found)


def test_recall_of_the_query(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, vectors = e.vec_id.to_numpy(), np.stack(e.embedding.tolist()).astype(float)
    found = queries.op10_nearest_neighbours(spark, SF).toPandas()
    assert set(found.query_id) == {i for i in ids if i % 20 == 0}
    hits = sum(len({i for i, _ in nearest(ids, vectors, q, 20)} & set(g.vec_id)) for q, g in found.groupby("query_id"))
    assert hits / len(found) >= 0.9
