"""Repeats of fixed-length windows over a whole corpus, found in two narrow shuffles.

A corpus has about as many windows as units, far too many to shuffle one by one. Windows that share their least
k-gram are therefore carried together as one path (`kernels.super_grams`): about one row per (window - k) / 2 units.
Equal windows always lie on paths with the same k-gram, so

1. paths are grouped by (k-gram, content): all but the first of equal paths repeat as wholes, nothing else is
   needed for them;
2. a k-gram with one distinct path is nonbranching and done; for the few branching ones the first occurrence of
   each distinct path is looked at again, window by window.

Every batch keeps one row of equal paths, the first, so a passage that a third of the corpus shares sends one row
per batch and not one per copy. A k-gram with more than GRAM_PATHS distinct paths in a batch is branching for sure:
the others are passed by, marked as branching, and need not meet in one task. Keys are 128 bits: the hash of the
k-gram and that of the covered content. Both are of hashes of units; who needs certainty compares contents where the
marks say (`source`, `source_first`: the first occurrence of a path that repeats), as `substring_dedup` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import written

#: Text whose equal paths are made one row before they are shuffled.
GATHERED_BYTES = 12 << 20
#: Distinct paths of a k-gram that a batch sends to the task of this k-gram.
GRAM_PATHS = 16
#: at: the first window, 31 bits, and the number of windows, 31 bits; state and salt: see path_finder.
PATH = "gram long, whole long, doc long, at long, state byte, salt int"
PLAIN, KNOWN, PASSED = 0, 1, 2


def units(data: np.ndarray, offsets: np.ndarray, kind: str, seed: int = 0, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and row offsets of a block: its bytes, or hashes of its words (of `bits` bits); and where each unit begins and ends."""
    if kind == "bytes":
        at = np.arange(len(data))
        return data, offsets, at, at + 1
    start, end, rows = K.words(data, offsets)
    codes = K.Rolling(data, K.MULTIPLIER_2).ranges(start, end)
    if seed:
        codes = K.mix(codes * K.U64(2 * seed + 1) + K.U64(seed))
    return (codes >> K.U64(64 - bits) if bits < 64 else codes), rows, start, end


def firsts(gram: np.ndarray, whole: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks, of rows with equal (gram, whole), the one with the least (doc, first); and for each row the number of that row."""
    both = K.mix(gram + whole * K.U64(K.MULTIPLIER))
    order = np.lexsort((first, doc, both))
    g, w = gram[order], whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    out, head = np.zeros(len(order), bool), np.empty(len(order), np.int64)
    out[order[new]] = True
    head[order] = order[new][np.cumsum(new) - 1] if len(order) else order
    return out, head


def same_content(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
    """Whether the n units from each a on are those from b on, byte by byte."""
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    one, two = np.repeat(a, n) + at, np.repeat(b, n) + at
    size = end[one] - start[one]
    if (size != end[two] - start[two]).any():
        return False
    for lo in range(0, len(one), 1 << 17):
        o, t, z = start[one[lo : lo + (1 << 17)]], start[two[lo : lo + (1 << 17)]], size[lo : lo + (1 << 17)]
        inner = np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
        if (data[np.repeat(o, z) + inner] != data[np.repeat(t, z) + inner]).any():
            return False
    return True


def path_finder(kind: str, window: int, k: int, seed: int = 0, bits: int = 64) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc, text) to rows of PATH.

    state KNOWN: repeats of a path of the same batch, compared with it and merged into ranges of windows; with n = 0
    (at = 0) they say that contents differ although hashes are equal. PASSED: first paths of a branching k-gram, beyond
    GRAM_PATHS. Both have a salt, which spreads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.blocks(K.buffers(batch.column(1))[1], GATHERED_BYTES):
                yield from gathered(batch.slice(lo, hi - lo))

    def gathered(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = K.buffers(batch.column(1))
        found: list[tuple] = []
        bounds: list[tuple] = []
        done = 0
        for i, j in K.blocks(offsets):
            codes, rows, start, end = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kind, seed, bits)
            g = K.super_grams(codes, rows, window, k)
            found.append((g["gram"], g["whole"], ids[i:j][g["row"]], g["first"], g["n"], done + rows[g["row"]] + g["first"]))
            if kind == "words":
                bounds.append((start + offsets[i], end + offsets[i]))
            done += len(codes)
        if not found:
            return
        gram, whole, doc, first, n, at = (np.concatenate(x) for x in zip(*found, strict=True))
        lead, head = firsts(gram, whole, doc, first)
        again = np.flatnonzero(~lead)
        again = again[np.lexsort((first[again], doc[again]))]
        d, s, e, a, b = doc[again], first[again], (first + n)[again], at[again], at[head[again]]
        differs = False
        if kind == "words" and len(again):
            # repeats that follow one another, like their first occurrences, are compared as one
            new = np.ones(len(d), bool)
            new[1:] = (a[1:] != a[:-1] + (e - s)[:-1]) | (b[1:] != b[:-1] + (e - s)[:-1]) | (d[1:] != d[:-1])
            edge = np.flatnonzero(new)
            last = np.append(edge[1:], len(d)) - 1
            start, end = (np.concatenate(x) for x in zip(*bounds, strict=True))
            differs = not same_content(data, start, end, a[edge], b[edge], (a + e - s)[last] - a[edge] + window - 1)
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] > e[:-1])  # paths of a document follow one another without overlap
        edge = np.flatnonzero(new)
        last = np.append(edge[1:], len(d)) - 1 if len(d) else edge
        d, s, e = d[edge], s[edge], e[last]
        if differs:
            d, s, e = np.append(d, ids[0]), np.append(s, 0), np.append(e, 0)
        gram, whole, doc, first, n = (x[lead] for x in (gram, whole, doc, first, n))
        order = np.argsort(gram, kind="stable")
        rank = np.empty(len(gram), np.int64)
        rank[order] = np.arange(len(gram)) - np.searchsorted(gram[order], gram[order])
        state = np.concatenate([np.where(rank >= GRAM_PATHS, PASSED, PLAIN), np.full(len(d), KNOWN)]).astype(np.int8)
        doc, at = np.concatenate([doc, d]), (np.concatenate([first, s]) << 31) | np.concatenate([n, e - s])
        salt = (K.mix(doc.astype(K.U64) + at.astype(K.U64) * K.U64(K.MULTIPLIER)) >> K.U64(33)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                K.long_array(np.concatenate([gram, np.zeros(len(d), K.U64)])),
                K.long_array(np.concatenate([whole, np.zeros(len(d), K.U64)])),
                pa.array(doc), pa.array(at), pa.array(state), pa.array(np.where(state == PLAIN, 0, salt).astype(np.int32)),
            ],
            names=["gram", "whole", "doc", "at", "state", "salt"],
        )

    return run


def marked_paths(texts: DataFrame, kind: str, window: int, k: int, seed: int = 0, bits: int = 64) -> DataFrame:
    """Of (doc, text): paths that repeat an earlier one (branching false), and first paths of branching k-grams (true).

    Columns gram, doc, first, n, branching, source, source_first (of repeats from another batch: where the path is
    first met); written to the shared folder.
    """
    paths = texts.mapInArrow(path_finder(kind, window, k, seed, bits), PATH).repartition("gram", "salt")
    same = Window.partitionBy("gram", "salt", "whole").orderBy("state", "doc", "at")
    node = Window.partitionBy("gram", "salt")
    seen = paths.withColumn("turn", F.row_number().over(same)).withColumn("source", F.first("doc").over(same)).withColumn("source_at", F.first("at").over(same))
    known, passed = F.col("state") == KNOWN, F.col("state") == PASSED
    repeat = known | (~passed & (F.col("turn") > 1))
    seen = seen.withColumn("branching", (F.min("whole").over(node) != F.max("whole").over(node)) | passed)
    first, n = F.shiftright("at", 31), F.col("at").bitwiseAND(F.lit((1 << 31) - 1))
    has = repeat & ~known
    return written(seen.filter(repeat | F.col("branching")).select(
        "gram", "doc", first.cast("int").alias("first"), n.cast("int").alias("n"), (~repeat).alias("branching"),
        F.when(has, F.col("source")).alias("source"), F.when(has, F.shiftright("source_at", 31).cast("int")).alias("source_first"),
    ))


def requested(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts (key, text) that hold branching paths, with the list `asked` of these paths. One row per document; a list is as long as its text at most."""
    key = texts.columns[0]
    asked = marks.filter("branching").groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("gram", "first", "n")).alias("asked"))
    return texts.join(asked, key)


def ranges(marks: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """(doc, spans): per document the unit ranges that repeated windows cover, unmerged and unordered."""
    whole = marks.filter("NOT branching").select("doc", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + window).alias("b"))
    single = windows.select("doc", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + window).alias("b"))
    return whole.unionByName(single).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def list_column(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of a column of lists of structs; a null is an empty list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    return np.concatenate([[0], np.cumsum(lengths)]), fields
