"""Chat formatting into a prefix tree: turns that conversations share from their beginning are emitted once.

A turn is formatted as <|im_start|>role\\ntext<|im_end|>\\n; control strings inside texts are escaped with a
backslash and can be restored. A node of the tree is a turn together with all turns before it (a 128-bit chained
hash). Conversations are sorted by their chains, which is the order of a depth-first walk: what a conversation shares
with the one before it in that order is emitted already, the rest follows. Tokens are code points, or ids of a tokenizer
file. Per node: `start` (which names it) and `length` in the emitted sequence, `position` (position id of its first
token, counted along its own conversation) and `attends` (intervals of the sequence that hold its ancestors,
neighbours merged).

Texts are shuffled once for the nodes, and once more to read conversations back; everything else is a hash and some
numbers a turn (24 bytes, which are held together for a conversation, while texts stream). No join has a node as its
key but for nodes that are shared, and these are spread by the number of their users, so a prompt that all
conversations begin with is in no single task.

Defined results: rows of a conversation are ordered by (turn, role, text), nulls last; a null role or text is empty;
repeated rows are turns of their own; a null conversation id is one conversation; an empty table gives none; equal
conversations share all their nodes. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: Users of a node that are joined with it in one task.
USERS = 10_000
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PIECE = re.compile(re.escape(OPEN) + r"(.*?)\n(.*)" + re.escape(CLOSE) + "\n", re.DOTALL)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def restored(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def piece(role: str, text: str) -> str:
    return f"{OPEN}{escaped(role)}\n{escaped(text)}{CLOSE}\n" if "\n" not in role else f"{OPEN}{escaped(role).replace(chr(10), chr(92) + 'n')}\n{escaped(text)}{CLOSE}\n"


def parsed(formatted: str) -> tuple[str, str]:
    """Role and text of a piece."""
    role, text = _PIECE.fullmatch(formatted).groups()
    return restored(role), restored(text)


def _tokens(tokenizer: str | None):
    if tokenizer is None:
        return lambda text: None
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer)
    return lambda text: loaded.encode(text, add_special_tokens=False).ids


ORDER = ["conv", "is_null", "turn", "role", "text"]
CONVERSATION = "conv long, is_null boolean, keys binary, lengths binary"
LOCAL = f"{CONVERSATION}, part int, starts binary, shared int, first_keys binary, first_lengths binary, total long"
PLACED = "conv long, is_null boolean, depth int, start long, length long, position long, owned boolean, attends array<struct<s:long,e:long>>"
NODE = "conv long, is_null boolean, depth int, start long, length long, position long, attends array<struct<s:long,e:long>>, users long, learned boolean, piece string, tokens array<int>"
WIDTH = 16


def _narrow(rows: DataFrame, tokenizer: str | None) -> DataFrame:
    """(conv, is_null, turn, role, tie, digest, length) of (.., text): what the tree needs of a turn. tie: its text, only where rows differ in nothing before it."""
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    if tokenizer is None:
        marks = lambda c: F.length(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|")))
        length = marks(F.col("role")) + F.regexp_count("role", F.lit("\n")) + marks(F.col("text")) + len(OPEN) + len(CLOSE) + 2
    else:

        @F.arrow_udf("long")
        def counted(role: pa.Array, text: pa.Array) -> pa.Array:
            encode = _tokens(tokenizer)
            return pa.array([len(encode(piece(r, t))) for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)], pa.int64())

        length = counted("role", "text")
    narrow = rows.select("conv", "is_null", "turn", "role", digest.alias("digest"), length.cast("long").alias("length"))
    keys = ["conv", "is_null", "turn", "role"]
    tied = written(narrow.groupBy(*keys).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select(*keys))
    if tied.isEmpty():
        return narrow.withColumn("tie", F.lit(None).cast("string"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = rows.withColumns({"digest": digest, "length": length.cast("long")}).alias("l").join(tied.withColumn("hit", F.lit(True)).alias("r"), same, "left")
    return both.select(*(f"l.{k}" for k in keys), "digest", "length", F.when(F.col("hit"), F.col("text")).alias("tie"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, is_null, digest, length) in order to CONVERSATION: chained keys and lengths of the turns."""
    names = [x.split()[0] for x in CONVERSATION.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    now, chain, keys, lengths = None, b"", [], []
    out: list[tuple] = []

    def close() -> None:
        out.append((*now, b"".join(keys), np.array(lengths, np.int64).tobytes()))

    for batch in batches:
        for conv, null, digest, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, null) != now:
                if now is not None:
                    close()
                now, chain, keys, lengths = (conv, null), b"\0" * WIDTH, [], []
            chain = hashlib.blake2b(chain + digest, digest_size=WIDTH).digest()
            keys.append(chain)
            lengths.append(length)
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
    if now is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def common_turns(a: bytes, b: bytes) -> int:
    """How many keys two chains have in common from their beginning."""
    n = min(len(a), len(b)) // WIDTH
    if not n:
        return 0
    same = (np.frombuffer(a, "V16", n) == np.frombuffer(b, "V16", n)) if n > 1 else np.array([a[:WIDTH] == b[:WIDTH]])
    return n if same.all() else int(np.argmin(same))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations of a partition to LOCAL: starts counted from the partition's beginning, and what is shared with the conversation before. The last row (conv null) sums the partition up: its first and last conversation."""
    names = [x.split()[0] for x in LOCAL.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    at, first, last, part = 0, None, None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        rows = []
        for conv, null, keys, lengths, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(lengths, np.int64)
            shared = common_turns(last[0], keys) if last else 0
            starts = np.concatenate([last[1][:shared] if last else n[:0], at + np.cumsum(n[shared:]) - n[shared:]])
            at += int(n[shared:].sum())
            first, last = first or (keys, lengths), (keys, starts)
            rows.append((conv, null, keys, lengths, part, starts.tobytes(), shared, None, None, None))
        if rows:
            yield batch_of(rows)
    if last:
        yield batch_of([(None, None, last[0], None, part, last[1].tobytes(), None, *first, at)])


def _fixes(sums: list) -> dict[int, tuple[int, bytes, np.ndarray]]:
    """Per partition: what to add to its starts, its first chain, and the starts of that chain's turns which the partition before has."""
    fixes, base, before = {}, 0, None
    for r in sorted(sums, key=lambda r: r["part"]):
        lengths = np.frombuffer(r["first_lengths"], np.int64)
        n = common_turns(before[0], r["first_keys"]) if before else 0
        held = before[1][:n] if before else lengths[:0]
        gone = int(lengths[:n].sum())
        fixes[r["part"]] = (base - gone, bytes(r["first_keys"]), held)
        starts = np.frombuffer(r["starts"], np.int64) + base - gone
        m = min(n, common_turns(r["keys"], r["first_keys"]))
        starts[:m] = held[:m]
        before = (bytes(r["keys"]), starts)
        base += r["total"] - gone
    return fixes


def _placed(shared: Broadcast):
    """LOCAL to PLACED, a row per turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixes = shared.value
        names = [x.split()[0] for x in PLACED.split(", ", 7)]
        kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
        for batch in batches:
            out: list[tuple] = []
            for conv, null, keys, lengths, part, starts, known in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                add, first, held = fixes[part]
                n = np.frombuffer(lengths, np.int64)
                at = np.frombuffer(starts, np.int64) + add
                m = min(len(held), common_turns(keys, first)) if len(held) else 0
                at[:m] = held[:m]
                known = max(known, m)
                position = np.cumsum(n) - n
                runs: list[dict] = []
                for depth, (s, size, p) in enumerate(zip(at.tolist(), n.tolist(), position.tolist(), strict=True)):
                    owned = depth >= known
                    out.append((conv, null, depth, s, size, p, owned, [dict(r) for r in runs] if owned else None))
                    if runs and runs[-1]["e"] == s:
                        runs[-1]["e"] = s + size
                    else:
                        runs.append({"s": s, "e": s + size})
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _emitted(tokenizer: str | None):
    """Per conversation its places (kind 0), then its turns (kind 1), each in order, to NODE: the turns that it owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokens(tokenizer)
        names = [x.split()[0] for x in ("conv, is_null, depth, start, length, position, attends, users, learned, piece, tokens").split(", ")]
        span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), span, pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32())]
        now, places, turn = None, {}, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, null, kind, depth, start, length, position, attends, users, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, null) != now:
                    now, places, turn = (conv, null), {}, 0
                if not kind:
                    places[depth] = (start, length, position, attends, users)
                    continue
                if (place := places.pop(turn, None)) is not None:
                    body = piece(role, text)
                    ids = encode(body)
                    if place[1] != len(body if ids is None else ids):
                        raise ValueError(f"turn {turn} of conversation {conv} changed since it was placed")
                    out.append((conv, null, turn, *place, role == LEARNED, body, ids))
                turn += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def prefix_tree(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths).

    nodes: start (the node's name), length, position, attends (intervals), learned, piece, tokens (null without a
    tokenizer), conv, is_null and depth (where the node is first met), users (conversations that meet it later).
    paths: conv, is_null, depth, start, length, owned: the nodes of each conversation.
    """
    rows = conversations.select(
        F.coalesce(F.col(conv_col), F.lit(0)).cast("long").alias("conv"), F.col(conv_col).isNull().alias("is_null"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    late = F.col("turn").asc_nulls_last()
    narrow = _narrow(rows, tokenizer).repartition("conv", "is_null").sortWithinPartitions("conv", "is_null", late, "role", "tie", "digest")
    chains = written(narrow.select("conv", "is_null", "digest", "length").mapInArrow(_chained, CONVERSATION))
    local = written(chains.orderBy("keys", "conv", "is_null").withColumn("part", F.spark_partition_id()).mapInArrow(_walked, LOCAL))
    fixes = _fixes(local.filter("conv IS NULL").collect())  # a row per partition
    shared = rows.sparkSession.sparkContext.broadcast(fixes)
    paths = written(local.filter("conv IS NOT NULL").mapInArrow(_placed(shared), PLACED))
    users = paths.filter("NOT owned").groupBy("start").agg(F.count(F.lit(1)).alias("users"))
    owned = paths.filter("owned").join(users, "start", "left").withColumn("users", F.coalesce("users", F.lit(0)))
    no = lambda kind: F.lit(None).cast(kind)
    places = owned.select("conv", "is_null", F.lit(0).alias("kind"), "depth", "start", "length", "position", "attends", "users", no(rows.schema["turn"].dataType).alias("turn"), no("string").alias("role"), no("string").alias("text"))
    turns = rows.select("conv", "is_null", F.lit(1).alias("kind"), no("int").alias("depth"), *(no(places.schema[c].dataType).alias(c) for c in ("start", "length", "position", "attends", "users")), "turn", "role", "text")
    ordered = places.unionByName(turns).repartition("conv", "is_null").sortWithinPartitions("conv", "is_null", "kind", "depth", late, "role", "text").drop("turn")
    return ordered.mapInArrow(_emitted(tokenizer), NODE), paths.select("conv", "is_null", "depth", "start", "length", "owned")


READ = "conv long, is_null boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations in order to their digests."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now = None
    state: list = []
    out: list[tuple] = []

    def close() -> None:
        n, turns, loss, learned, chars = state
        out.append((*now, n, turns.hexdigest(), loss, learned.hexdigest(), chars))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for conv, null, learned, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (conv, null) != now:
                if now is not None:
                    close()
                now, state = (conv, null), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parsed(body)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if learned:
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(body)
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    if now is not None:
        close()
    if out:
        yield batch_of(out)


def read_back(nodes: DataFrame, paths: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the emitted tree: turns, their digest, the text under the loss mask, and the formatted length."""
    pieces = nodes.select("conv", "is_null", "depth", "learned", "piece")
    met = paths.filter("NOT owned")
    if not met.isEmpty():
        spread: Column = F.ceil(F.col("users") / USERS).cast("int")
        shared = nodes.filter("users > 0").select("start", "learned", "piece", spread.alias("of"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"))
        number = met.groupBy("start").agg(F.ceil(F.count(F.lit(1)) / USERS).cast("int").alias("of"))
        large = number.filter("of > 1")  # few: a node of so many users each
        salted = met.join(F.broadcast(large) if large.count() < 100_000 else large, "start", "left").withColumn("salt", F.pmod(F.xxhash64("conv", "is_null"), F.coalesce("of", F.lit(1))).cast("int")).drop("of")
        pieces = pieces.unionByName(salted.join(shared, ["start", "salt"]).select(*pieces.columns))
    pieces = pieces.repartition("conv", "is_null").sortWithinPartitions("conv", "is_null", "depth")
    found = pieces.select("conv", "is_null", "learned", "piece").mapInArrow(_read, READ)
    return found.select(F.when(~F.col("is_null"), F.col("conv")).alias(conv_col), *[x.split()[0] for x in READ.split(", ")[2:]])
