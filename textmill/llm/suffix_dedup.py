"""Removal of byte strings that occur earlier in the corpus, by induced sorting of suffix shards.

A suffix array over all bytes can't be shuffled (eight bytes and more per byte of text), so suffixes that can't
share `window` bytes with another never reach a shard: `windows` routes all windows by their least k-gram, settles
equal paths and k-grams with one path, and leaves the branching ones. Their bytes are cut at the k-gram into at
most two pieces, which are routed by hash of three quarters of a window that all windows of a piece share; so a
k-gram with very many contexts is spread, and pieces without a partner drop out. A route of more than ROUTE_PIECES
pieces (counted over all data) is not sorted: its windows are grouped by their bytes, one by one. So a shard, which is
the concatenation of its pieces, has a bounded size whatever the data; `induced.Sorter` gives its suffix array and
common prefixes. Neighbours with a common prefix of `window` are equal windows; all but the first by (document, byte)
repeat.

Defined results: a null text is empty; texts shorter than `window` bytes lose none; copies lose all bytes of all
but the first; rows that share an id are ordered by text. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import windows as P
from .common import free_name, keyed, shared_folder, written
from .induced import END, SEPARATOR, SHIFT, Sorter

WINDOW, KMER = 100, 50
#: body is null for a piece that equals an earlier one of its batch; n is its number of windows.
PIECE = "route long, doc long, first int, n int, body binary"
SHARD_BYTES = 1 << 20
#: So a shard is under SHARD_BYTES and this many pieces of less than two windows.
ROUTE_PIECES = 4096
#: Of a shard's waiting tuples, beyond which they go to the shared folder, if that is a mounted one.
QUEUE_BYTES = 8 << 20


def _pieces(window: int, k: int):
    """Bytes of the asked-for paths, cut at the k-gram: (route, document, first byte, bytes)."""
    context = (window - k) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = K.buffers(batch.column(1))
            at, asked = P.list_column(batch.column(2))
            for i, j in K.blocks(offsets):
                body, rows = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                gram = asked["gram"][at[i] : at[j]].astype(np.int64).view(K.U64)
                first, n = (asked[f][at[i] : at[j]].astype(np.int64) for f in ("first", "n"))
                if not len(gram):
                    continue
                row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                rolling = K.Rolling(body)
                start = rows[row] + first
                anchor = np.full(len(gram), -1)
                for step in range(window - k + 1):  # the leftmost place where the k-gram stands in all windows of the path
                    place = start + n - 1 + step
                    open_ = np.flatnonzero((anchor < 0) & (place <= start + window - k))
                    place = place[open_]
                    hit = rolling.grams_at(place, k) == gram[open_]
                    anchor[open_[hit]] = place[hit]
                last = start + n - 1
                split = np.clip(anchor - context, start - 1, last)  # last window with `context` bytes before the k-gram
                out = []
                for lo, hi, from_ in ((start, split, anchor - context), (split + 1, last, anchor)):
                    held = np.flatnonzero(hi >= lo)
                    to = from_[held] + k + context
                    out.append((rolling.ranges(from_[held], to), row[held], lo[held], hi[held] + window))
                route, of, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                doc, first = ids[i:j][of], a - rows[of]
                lead, _ = P.firsts(route, rolling.ranges(a, b), doc, first)
                route[~lead] = K.mix(doc[~lead].astype(K.U64))  # known repeats are sent anywhere
                bodies = [body[x:y].tobytes() if z else None for x, y, z in zip(a.tolist(), b.tolist(), lead.tolist(), strict=True)]
                n = (b - a - window + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([K.long_array(route), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(n), pa.array(bodies, pa.binary())], names=["route", "doc", "first", "n", "body"])

    return run


def repeats_of(doc: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of a shard's pieces that also start earlier."""
    n = len(doc)
    lengths = np.diff(offsets)
    text = np.full(len(data) + n + 1, SEPARATOR, np.uint16)
    place = np.arange(len(data)) + np.repeat(np.arange(n), lengths)
    text[place] = data.astype(np.uint16) + SHIFT
    text[-1] = END
    order, prefix = Sorter(text, window, QUEUE_BYTES, folder).run()
    begins = offsets[:-1] + np.arange(n)
    piece = np.searchsorted(begins, order, "right") - 1
    offset = order - begins[piece]
    whole = offset + window <= lengths[piece]
    same = prefix >= window
    run = np.cumsum(~same)[whole]
    d, s = doc[piece[whole]], first[piece[whole]] + offset[whole]
    by = np.lexsort((s, d, run))
    run, d, s = run[by], d[by], s[by]
    again = np.zeros(len(run), bool)
    again[1:] = run[1:] == run[:-1]
    return d[again], s[again]


def _shards(window: int, most: int, folder: str | None):
    """Batches sorted by route to (doc, first, n). Pieces gather up to `most` bytes, cut between routes; equal pieces are one, and routes of one piece drop out."""

    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        known = table.column(4).is_null().to_numpy(zero_copy_only=False)
        route, doc = table.column(0).to_numpy().view(K.U64), table.column(1).to_numpy()
        first, n = (table.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        data, offsets = K.buffers(table.column(4))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        # equal pieces are sorted once: all but the first repeat as wholes
        at = np.flatnonzero(~known)
        lead = np.zeros(len(route), bool)
        lead[at] = P.firsts(route[at], K.Rolling(data).ranges(offsets[:-1][at], offsets[1:][at]), doc[at], first[at])[0]
        again = ~lead
        d, s = np.repeat(doc[again], n[again]), np.repeat(first[again], n[again])
        s = s + np.arange(len(s)) - np.repeat(np.cumsum(n[again]) - n[again], n[again])
        at = np.flatnonzero(lead)
        partner = np.zeros(len(at), bool)
        partner[1:] = route[at][1:] == route[at][:-1]
        partner[:-1] |= partner[1:].copy()
        at = at[partner]
        if len(at):
            body, edges = K.buffers(table.column(4).take(pa.array(at)))
            more = repeats_of(doc[at], first[at], body[edges[0] : edges[-1]], edges - edges[0], window, folder)
            d, s = np.concatenate([d, more[0]]), np.concatenate([s, more[1]])
        if not len(d):
            return None
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)]))
        last = np.append(at[1:], len(d)) - 1
        return pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(s[at].astype(np.int32)), pa.array((s[last] - s[at] + 1).astype(np.int32))], names=["doc", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            route = batch.column(0).to_numpy()
            if size >= most:
                cuts = np.flatnonzero(np.concatenate([[route[0] != held[-1].column(0)[-1].as_py()], route[1:] != route[:-1]]))
                if len(cuts):
                    held.append(batch.slice(0, cuts[0]))
                    if out := settled(held):
                        yield out
                    held, size, batch = [], 0, batch.slice(cuts[0])
            held.append(batch)
            size += batch.column(4).nbytes
        if held and (out := settled(held)):
            yield out

    return run


def _removed(text: int, spans: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = P.list_column(batch.column(spans))
            kept, size, removed, runs = [], [], [], []
            data, offsets = K.buffers(batch.column(text))
            for i in range(batch.num_rows):
                body = data[offsets[i] : offsets[i + 1]].tobytes()
                lo, hi = at[i], at[i + 1]
                gone, parts, done, n = 0, [], 0, 0
                if hi > lo:
                    a, b = K.merged(found["a"][lo:hi].astype(np.int64), found["b"][lo:hi].astype(np.int64))
                    n = len(a)
                    for s, e in zip(a.tolist(), b.tolist(), strict=True):
                        parts.append(body[done:s])
                        gone, done = gone + e - s, e
                parts.append(body[done:])
                kept.append(b"".join(parts))
                size.append(len(body))
                removed.append(gone)
                runs.append(n)
            columns = [batch.column(k) for k in range(batch.num_columns) if k != spans]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, removed, runs))], names=names)

    return run


def _one_by_one(pieces: DataFrame, window: int) -> DataFrame:
    """(doc, first, n) of the windows of pieces that are also in an earlier one, by their bytes; no task holds a route.

    A piece without bytes repeats one of its batch, and so do all its windows.
    """
    known = pieces.filter("body IS NULL").select("doc", "first", "n")
    each = pieces.filter("body IS NOT NULL").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.select("doc", (F.col("first") + F.col("at")).alias("first"), F.expr(f"substring(body, at + 1, {window})").alias("body"))
    # the first of equal windows is found by a minimum, combined before the shuffle
    least = each.groupBy("body").agg(F.min(F.struct("doc", "first")).alias("lead"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("body", "lead")
    found = each.join(least, "body").filter("lead.doc <> doc OR lead.first <> first")
    return known.unionByName(found.select("doc", "first", F.lit(1).alias("n")))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = KMER) -> DataFrame:
    """docs with kept (binary: the bytes that no earlier window covers), n_bytes, n_removed and n_spans (a name in use is lengthened)."""
    rows, key = keyed(docs, id_col, text_col, free_name(docs, "_key"))
    texts = rows.select(key, text_col)  # not renamed: both joins then share one shuffle of the texts
    marks = P.marked_paths(texts, "bytes", window, k)
    pieces = written(P.requested(marks, texts).select(key, text_col, "asked").mapInArrow(_pieces(window, k), PIECE))
    hot = written(pieces.filter("body IS NOT NULL").groupBy("route").count().filter(F.col("count") > ROUTE_PIECES).select("route", F.lit(True).alias("hot")))
    some = not hot.isEmpty()
    plain = pieces.join(hot, "route", "left_anti") if some else pieces
    folder = shared_folder(docs.sparkSession).removeprefix("file://")
    shards = plain.repartition("route").sortWithinPartitions("route").mapInArrow(_shards(window, SHARD_BYTES, folder if folder.startswith("/") else None), "doc long, first int, n int")
    again = shards.unionByName(_one_by_one(pieces.join(hot, "route", "left_semi"), window)) if some else shards
    spans_name = free_name(docs, "spans")
    spans = P.ranges(marks, again, window).select(F.col("doc").alias(key), F.col("spans").alias(spans_name))
    joined = rows.join(spans, key, "left").select(*docs.columns, spans_name)
    extra = [("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(free_name(docs, n), t) for n, t in extra)])
    return joined.mapInArrow(_removed(docs.columns.index(text_col), len(docs.columns), schema.names), schema)
