"""Removal of word passages that occur earlier in the corpus, by compacting a de Bruijn graph of token k-mers.

A k-mer of `window` words is an edge between the words that it begins and ends with (all but one). Edges that share
their least `k`-gram are carried together, as one run (`windows`): where all runs of a `k`-gram are equal, the graph
doesn't branch there and they are one edge that repeats; the runs of a branching one are taken apart into single
k-mers, which are joined by a digest of their words.

Repeated runs are compacted by joins on coordinates: a run goes on with the one that begins where it ends, if the first
occurrences (the sources) of both do so too. So a nonbranching path, however long, is one row: a span of a document
and its source. Then both ends are visited. The words of the span and those at the source's coordinates are digested
(128 bits, BLAKE2) and the digests of a source span must all be equal; repeats within a batch are compared word by
word at once. Where contents differ although hashes were equal, everything is done again with other hashes.

Defined results: a null or wordless text has no words and loses none; documents of fewer than `window` words lose
none; copies lose all words of all but the first; rows that share an id are ordered by text; rows that are equal
in all columns are ordered arbitrarily, so all but one lose the repeated words; an empty table stays empty. Other
columns are kept, whatever their names; `text` becomes the kept words joined by one space (null stays null).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import windows as P
from .common import free_name, keyed, written

WINDOW, KMER = 20, 10
#: kind EDGE: a single k-mer (low, high: digest of its words) at (doc, first). KNOWN: one that repeats in its batch.
#: SPAN: the digest of the n words at (doc, first), for the span of this place.
VISITED = "kind byte, low long, high long, doc long, first int, n int"
EDGE, KNOWN, SPAN = 0, 1, 2
ASKED = "array<struct<kind:int,first:int,n:int,doc:bigint,at:int>>"
REQUESTS = 10_000
BITS = 64


def compacted(marks: DataFrame, window: int) -> DataFrame:
    """(doc, first, n, source, source_first): the spans of words of maximal repeated paths and where they are first met."""
    runs = marks.filter("source IS NOT NULL").select("doc", "first", "n", "source", "source_first")
    before = runs.select("doc", (F.col("first") + F.col("n")).alias("first"), "source", (F.col("source_first") + F.col("n")).alias("source_first"), F.lit(True).alias("follows"))
    linked = runs.join(before, ["doc", "first", "source", "source_first"], "left").withColumn("line", F.col("source_first") - F.col("first"))
    along = Window.partitionBy("doc", "source", "line").orderBy("first")
    linked = linked.withColumn("path", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(along))
    return linked.groupBy("doc", "source", "line", "path").agg(F.min("first").alias("first"), (F.sum("n") + window - 1).cast("int").alias("n")).select(
        "doc", "first", "n", "source", (F.col("first") + F.col("line")).alias("source_first")
    )


def _requests(marks: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, part, asked): what a document is asked for: its k-mers, its spans, and the spans that others have of it. Lists are about REQUESTS long at most."""
    item = lambda kind, first, n, doc, at: F.struct(F.lit(kind).alias("kind"), F.col(first).alias("first"), F.col(n).alias("n"), (F.col(doc) if doc else F.lit(None).cast("long")).alias("doc"), (F.col(at) if at else F.lit(None).cast("int")).alias("at"))
    sources = spans.select("source", "source_first", "n").distinct()
    wanted = marks.filter("branching").select("doc", item(EDGE, "first", "n", None, None).alias("x"))
    wanted = wanted.unionByName(spans.select("doc", item(SPAN, "first", "n", "source", "source_first").alias("x")))
    wanted = wanted.unionByName(sources.select(F.col("source").alias("doc"), item(SPAN, "source_first", "n", "source", "source_first").alias("x")))
    many = sources.groupBy(F.col("source").alias("doc")).count().filter(F.col("count") > REQUESTS).select("doc", F.ceil(F.col("count") / REQUESTS).cast("int").alias("parts"))
    wanted = wanted.join(many, "doc", "left").withColumn("part", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1))).cast("int"))
    return wanted.groupBy(F.col("doc").alias(key), "part").agg(F.collect_list("x").alias("asked"))


def _visited(window: int):
    """(doc, text, asked) to VISITED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[bytes] = []
            rows: list[tuple[int, int, int, int]] = []
            at, asked = P.list_column(batch.column(2))
            fields = {f: pa.array(v).to_pylist() for f, v in asked.items()}
            for r, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = text.encode().split()
                body = b" ".join(words)
                end = np.cumsum([len(w) + 1 for w in words]) - 1
                start = (end - [len(w) for w in words]).tolist()
                end = end.tolist()
                for i in range(at[r], at[r + 1]):
                    first, n = fields["first"][i], fields["n"][i]
                    if fields["kind"][i] == SPAN:
                        digests.append(hashlib.blake2b(body[start[first] : end[first + n - 1]], digest_size=16).digest())
                        rows.append((SPAN, int(fields["doc"][i]), int(fields["at"][i]), n))
                        continue
                    for j in range(first, first + n):
                        digests.append(hashlib.blake2b(body[start[j] : end[j + window - 1]], digest_size=16).digest())
                        rows.append((EDGE, doc, j, 1))
            if not rows:
                continue
            key = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kind, doc, first, n = (np.array(x) for x in zip(*rows, strict=True))
            kmer = np.flatnonzero(kind == EDGE)
            lead, _ = P.firsts(key[kmer, 0].copy().view(K.U64), key[kmer, 1].copy().view(K.U64), doc[kmer], first[kmer])
            kind[kmer[~lead]] = KNOWN
            keep = np.ones(len(kind), bool)  # equal digests of a source's span are one
            span = np.flatnonzero(kind == SPAN)
            if len(span):
                _, once = np.unique(np.stack([key[span, 0], key[span, 1], doc[span], first[span], n[span]]), axis=1, return_index=True)
                keep[span] = False
                keep[span[once]] = True
            columns = [pa.array(x[keep], t) for x, t in ((kind, pa.int8()), (key[:, 0], pa.int64()), (key[:, 1], pa.int64()), (doc, pa.int64()), (first, pa.int32()), (n, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in VISITED.split(", ")])

    return run


def repeats(texts: DataFrame, window: int, k: int, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(marks, k-mers): runs and single k-mers of (key, text) that repeat earlier ones, verified at their sources."""
    key, text = texts.columns
    for seed in itertools.count():
        marks = P.marked_paths(texts, "words", window, k, seed, bits)
        if marks.filter("NOT branching AND n = 0").isEmpty():
            asked = _requests(marks, compacted(marks, window), key)
            visited = written(texts.join(asked, key).select(key, text, "asked").mapInArrow(_visited(window), VISITED))
            held = visited.filter(F.col("kind") == SPAN).groupBy("doc", "first", "n").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("low", "high") for f in (F.min, F.max)))
            if held.filter("min_low <> max_low OR min_high <> max_high").isEmpty():
                break
        bits = 64
    order = Window.partitionBy("low", "high").orderBy("doc", "first")
    single = visited.filter(F.col("kind") == EDGE).select("low", "high", "doc", "first").repartition("low", "high")
    again = single.withColumn("at", F.row_number().over(order)).filter("at > 1").select("doc", "first")
    again = again.unionByName(visited.filter(F.col("kind") == KNOWN).select("doc", "first"))
    return marks, again.withColumn("n", F.lit(1))


def _removed(text: int, spans: int, out: pa.Schema):
    """Batches with the text at column `text` and its spans at column `spans` to the same with the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = P.list_column(batch.column(spans))
            kept, words, removed = [], [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                tokens = value.encode().split() if value else []
                lo, hi = at[i], at[i + 1]
                gone = 0
                if hi > lo:
                    a, b = K.merged(found["a"][lo:hi].astype(np.int64), found["b"][lo:hi].astype(np.int64))
                    parts, done = [], 0
                    for s, e in zip(a.tolist(), b.tolist(), strict=True):
                        parts += tokens[done:s]
                        gone, done = gone + e - s, e
                    parts += tokens[done:]
                else:
                    parts = tokens
                kept.append(None if value is None else b" ".join(parts).decode())
                words.append(len(tokens))
                removed.append(gone)
            columns = [pa.array(kept, pa.string()) if k == text else batch.column(k) for k in range(batch.num_columns) if k != spans]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=out)

    return run


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = KMER, bits: int = BITS) -> DataFrame:
    """docs with `text_col` cut to the words that no earlier window covers, and n_words and n_removed (a name in use is lengthened). bits: of the first hashes of words; fewer collide more."""
    rows, key = keyed(docs, id_col, text_col, free_name(docs, "_key"))
    marks, again = repeats(rows.select(key, text_col).filter(F.col(text_col).isNotNull()), window, k, bits)
    spans_name = free_name(docs, "spans")
    spans = P.ranges(marks, again, window).select(F.col("doc").alias(key), F.col("spans").alias(spans_name))
    joined = rows.join(spans, key, "left").select(*docs.columns, spans_name)
    words, removed = free_name(docs, "n_words"), free_name(docs, "n_removed")
    schema = T.StructType([*docs.schema.fields, T.StructField(words, T.LongType()), T.StructField(removed, T.LongType())])
    return joined.mapInArrow(_removed(docs.columns.index(text_col), len(docs.columns), schema.names), schema)
