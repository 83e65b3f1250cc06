"""Mixing of sources to target weights: packed blocks, multinomial draws per output shard, permuted block indices.

The words of a source are packed into blocks: documents follow one another in the order of a hash of id and text, so
that it doesn't depend on how rows are stored. Blocks have `block` words, and fewer in small sources (PARTS blocks at
least), so that these come near their targets too. The mix is a sequence of slots, in shards of about `shard_slots`.
Each source spreads its slots over the shards by a multinomial draw: the totals come out at the targets, and given a
shard's length its sources are drawn by the targets, so any shard is a fair sample of the mix. The j-th slot of a
source holds block perm(j), where perm runs through a pseudorandom permutation of the source's blocks once per epoch:
no block is used twice as often as another plus one. Slots and blocks are joined by (source, block index).

Everything of a source's or a shard's number is a table; the driver sees sums only. Equal documents are counted before
they are numbered, so copies in any number are one row there.

Defined results: a null text has size 0; a null source is a source of its own and sorts last; a source without
words has target 0 and takes nothing; rows that share an id are separate documents; rows equal in id, source and text
are interchangeable; no documents, no slots. A source's target stops at `most` times its words; what that leaves over
is shared again by weight. Columns other than id, source and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, numbered, written

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK, SHARD_SLOTS, SHARE, MOST, SEED = 128, 4096, 1.5, 2.0, 17
#: Blocks of a small source.
PARTS = 256
ROWS_PER_BUCKET = 20_000
#: Shards, and copies of a document, that are handled at a time.
STRETCH = 1 << 16
ROUNDS = 4


def words_of(text_col: str) -> Column:
    return F.expr(f"regexp_extract_all(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")


def with_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (size, weight) with target: share x all words by weight, none above most x its size, the excess reshared.

    That is min(most x size, level x weight); each round raises the level by what the sources at their limit leave.
    """
    total, weight = sources.filter("size > 0").agg(F.sum("size"), F.sum("weight")).first()
    level, full = share * (total or 0) / (weight or 1.0), -1
    while True:
        at_limit = F.lit(level) * F.col("weight") > most * F.col("size")
        n, held, free = sources.filter("size > 0").agg(F.count_if(at_limit), F.sum(F.when(at_limit, F.col("size"))), F.sum(F.when(~at_limit, F.col("weight")))).first()
        if n == full or not free:
            break
        level, full = (share * total - most * (held or 0)) / free, n
    return sources.withColumn("target", F.when(F.col("size") > 0, F.least(F.lit(most) * F.col("size"), F.lit(level) * F.col("weight"))).otherwise(0.0))


def spread(source: int, slots: int, shards: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shard, number of slots) of a source: multinomial over the shards, a stretch of shards at a time; none of no slots."""
    if 4 * slots < shards:
        yield np.unique(np.random.default_rng([seed, source]).integers(0, shards, slots), return_counts=True)
        return
    rng = np.random.default_rng([seed, source])
    left = slots
    for lo in range(0, shards, STRETCH):
        n = min(STRETCH, shards - lo)
        here = left if lo + n == shards else int(rng.binomial(left, n / (shards - lo)))
        counts = rng.multinomial(here, np.full(n, 1 / n))
        at = np.flatnonzero(counts)
        left -= here
        yield at + lo, counts[at]


def _keys(source: int, epoch: int, seed: int) -> list[int]:
    return list(np.frombuffer(hashlib.sha256(f"{seed}/{source}/{epoch}".encode()).digest(), np.uint64)[:ROUNDS].tolist())


def permuted(index: np.ndarray, n: int, source: int, epoch: int, seed: int) -> np.ndarray:
    """Images of 0 <= index < n under a pseudorandom permutation of range(n): a Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), _keys(source, epoch, seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            f = (right + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & low)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def measured(docs: DataFrame) -> DataFrame:
    """Of (_id, _name, _text): the different documents with _size (words), _copies, and _order and _bucket (by hash of id and text) for the running sum.

    The running sum has two levels, so that a source that holds most rows isn't in one task: rows are hashed into
    buckets, buckets are summed, and only within a bucket is there a sum over rows.
    """
    size = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.coalesce(F.size(words_of("_text")), F.lit(0))).cast("long")
    rows = docs.select("_id", "_name", size.alias("_size"), F.xxhash64("_id", F.col("_text").isNull(), "_text").alias("_order"))
    each = written(rows.groupBy("_id", "_name", "_size", "_order").agg(F.count(F.lit(1)).alias("_copies")))
    buckets = max(1, -(-each.count() // ROWS_PER_BUCKET))
    return each.withColumn("_bucket", F.pmod("_order", F.lit(buckets)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, blocks, slots) of the mix.

    documents: id, source, size, source_size, target, taken (words of the document in the mix, repeats counted).
    blocks: _source, block, and the piece of a document (id, first word, n words) that stands in it.
    slots: shard, slot, _source, block.
    Weights repeat over the sources in code point order.
    """
    sized = measured(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_name"), F.col(text_col).alias("_text")))
    words = F.col("_size") * F.col("_copies")
    sums = sized.groupBy("_name", "_bucket").agg(F.sum(words).alias("_sum"), F.max("_copies").alias("_most"))
    named = numbered(sums.groupBy("_name").agg(F.sum("_sum").alias("size"), F.max("_most").alias("_most")).orderBy(F.col("_name").asc_nulls_last()), "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_source") % len(weights) + 1).cast("int"))
    info = with_targets(named.withColumn("weight", weight), share, most)
    each = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("size") / PARTS))).cast("long")
    info = info.withColumn("_words", each).withColumn("_blocks", F.ceil(F.col("size") / F.col("_words")).cast("long"))
    info = info.withColumn("_slots", F.when(F.col("size") > 0, F.least(F.round(F.col("target") * F.col("_blocks") / F.col("size")), F.floor(most * F.col("_blocks")))).otherwise(0).cast("long"))
    info = written(info.select("_name", "_source", F.col("size").alias("source_size"), "target", "_words", "_blocks", "_slots", "_most"))

    before = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum", "_most")
    starts = starts.alias("l").join(info.alias("r"), F.col("l._name").eqNullSafe(F.col("r._name"))).select("l._name", "l._bucket", "l._base", "_source", "source_size", "target", "_words")
    inside = Window.partitionBy("_name", "_bucket").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    at = sized.withColumn("_before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    same_bucket = (F.col("l._name").eqNullSafe(F.col("r._name"))) & (F.col("l._bucket") == F.col("r._bucket"))
    at = at.alias("l").join(starts.alias("r"), same_bucket).select("_id", "l._name", "_size", "_copies", (F.col("_base") + F.col("_before")).alias("_at"), "_source", "source_size", "target", "_words")
    # a row per copy again, a stretch of them at a time
    at = at.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / STRETCH))))
    if (info.agg(F.max("_most")).first()[0] or 0) > STRETCH:
        at = at.repartition("_id", "_source", "_at", "_stretch")
    copy = F.explode(F.sequence(F.col("_stretch") * STRETCH, F.least(F.col("_copies"), (F.col("_stretch") + 1) * STRETCH) - 1))
    at = at.withColumn("_copy", copy).withColumn("_at", F.col("_at") + F.col("_copy") * F.col("_size"))
    at = written(at.withColumn("_row", F.monotonically_increasing_id()).drop("_copies", "_stretch", "_copy"))
    covered = F.explode(F.sequence(F.floor(F.col("_at") / F.col("_words")), F.floor((F.col("_at") + F.col("_size") - 1) / F.col("_words"))))
    pieces = at.filter("_size > 0").select("_row", "_id", "_source", "_at", "_size", "_words", covered.alias("block"))
    low = F.greatest("_at", F.col("block") * F.col("_words"))
    high = F.least(F.col("_at") + F.col("_size"), (F.col("block") + 1) * F.col("_words"))
    pieces = pieces.select("_row", "_id", "_source", "block", (low - F.col("_at")).alias("first"), (high - low).alias("n"))
    drawn = drawn_slots(info, shard_slots, seed)
    used = drawn.groupBy("_source", "block").agg(F.count(F.lit(1)).alias("_times"))
    taken = pieces.hint("merge").join(used, ["_source", "block"]).groupBy("_row").agg(F.sum(F.col("n") * F.col("_times")).alias("taken"))
    documents = at.hint("merge").join(taken, "_row", "left").select(
        F.col("_id").alias(id_col), F.col("_name").alias(source_col), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return documents, pieces.drop("_row").withColumnRenamed("_id", id_col), drawn


def drawn_slots(info: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """A row per slot: shard, slot, _source and the block it holds. info: _source, _slots, _blocks; a row per source."""
    total = info.agg(F.sum("_slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, slots, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = 0
                for shard, n in spread(source, slots, shards, seed) if slots else ():
                    at = first + np.cumsum(n) - n
                    first += int(n.sum())
                    same = [pa.array(np.full(len(shard), v, np.int64)) for v in (source, blocks)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard), *same, pa.array(at), pa.array(n)], names=["shard", "_source", "blocks", "first", "n"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, blocks, first, n = (c.to_numpy() for c in batch.columns)
            held = [source[:0], source[:0], source[:0]]
            for i in range(0, len(n), 64):  # the rows of a source follow one another
                part = slice(i, i + 64)
                row = np.repeat(np.arange(len(n[part])), n[part])
                index = np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + first[part][row]
                of, epoch = source[part][row], index // blocks[part][row]
                out = np.empty(len(row), np.int64)
                edges = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (epoch[1:] != epoch[:-1])])) if len(of) else of
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(of)], strict=True):
                    size, e = int(blocks[part][row[a]]), int(epoch[a])
                    out[a:b] = permuted(index[a:b] - e * size, size, int(of[a]), e, seed)
                held = [np.concatenate([h, x]) for h, x in zip(held, (shard[part][row], of, out), strict=True)]
                if len(held[0]) > STRETCH or i + 64 >= len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["shard", "_source", "block"])
                    held = [source[:0], source[:0], source[:0]]

    tasks = max(1, int(info.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # stated, or the few small rows end in one task
    counts = info.filter("_slots > 0").select("_source", "_slots", "_blocks").mapInArrow(draw, "shard long, _source long, blocks long, first long, n long")
    rows = counts.repartition(tasks, "shard").sortWithinPartitions("_source", "first").mapInArrow(fill, "shard long, _source long, block long")
    order = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "_source", "block", F.lit(seed)), "_source", "block")
    return rows.withColumn("slot", (F.row_number().over(order) - 1).cast("long")).select("shard", "slot", "_source", "block")


def packed_text(docs: DataFrame, id_col: str, text_col: str, pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix itself: shard, slot, and the block's words joined by one space. Documents need unique ids here."""
    name = free_name(docs, "_words")
    tokens = docs.select(id_col, words_of(text_col).alias(name))
    part = pieces.join(tokens, id_col).select("_source", "block", F.col(id_col), "first", F.array_join(F.slice(name, (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ").alias("part"))
    block = part.groupBy("_source", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(id_col, "first", "part"))), lambda x: x["part"]), " ").alias("text"))
    return slots.join(block, ["_source", "block"]).select("shard", "slot", "_source", "text")
