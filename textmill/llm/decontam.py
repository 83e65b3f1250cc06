"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the test questions and answers.

Texts are normalised (A-Z lower-cased; words are runs of digits, a-z and non-ASCII bytes), and every word that an item
has becomes a code of CODE characters, all others another; so the automaton has CODE nodes per word of a window, not one
per byte. Texts are scanned once, where as many words in a row have codes as the shortest window has. Matches are mapped back to words, and to character offsets of the original text.

Every worker holds the automaton, so its nodes are counted first (words of the items times window and CODE). Beyond
MOST_NODES, items are spread over several automata, long ones in pieces that overlap; each scans the texts and writes
what it found, rows of hit documents only, and the findings of a document are put together.

Defined results: a null or wordless text has no words and no hits; an item without words (or null) has no window;
items of fewer words than `window` are one window; repeated items count once per id; windows of a null id mark
words, but no item. An empty benchmark marks nothing; an empty table stays empty; repeated rows are marked each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import free_name, written

WINDOW = 10
#: About 120 MB of a worker, and 15 MB that are broadcast.
MOST_NODES = 3_000_000
#: Characters of a word's code: digits of its number to the base 64, each place with an alphabet of its own.
CODE = 3
PIECE_WORDS = 20_000
KEEP = np.array([0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A or c >= 0x80 for c in range(256)])
LOWER = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if KEEP[c] else 0x20 for c in range(256))
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
OTHER = "\0" * CODE
_BUILT: dict = {}


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def code(number: int) -> str:
    return "".join(chr(1 + 64 * place + (number >> 6 * place) % 64) for place in range(CODE))


def patterns(items: list[tuple[str | None, str | None]], window: int) -> tuple[dict[bytes, str], dict[str, tuple[int, tuple[str, ...]]]]:
    """The codes of the words, and window (of codes) to its number of words and the ids of the items that hold it."""
    codes: dict[bytes, str] = {}
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        w = [codes.setdefault(x, code(len(codes))) for x in normal_words(text)]
        for p in range(max(1, len(w) - window + 1) if w else 0):
            part = w[p : p + window]
            ids = found.setdefault("".join(part), (len(part), set()))[1]
            if item is not None:
                ids.add(item)
    if len(codes) > 64**CODE:
        raise ValueError("more different words than codes")
    return codes, {k: (n, tuple(sorted(ids))) for k, (n, ids) in found.items()}


Scanner = tuple[dict[bytes, str], ahocorasick.Automaton | None, re.Pattern | None]


def automaton(shared: Broadcast) -> Scanner:
    """Codes, automaton (None without patterns), and the pattern of stretches that can hold a window, of this worker."""
    me, codes, found = shared.value
    if me not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for key, value in found.items():
            built.add_word(key, value)
        if len(built):
            built.make_automaton()
        least = min((n for n, _ in found.values()), default=1)
        _BUILT[me] = codes, built if len(built) else None, re.compile("[^\0]{%d,}" % (CODE * least))
    return _BUILT[me]


def scan(scanner: Scanner, text: str | None) -> tuple[int, np.ndarray, list[str]]:
    """Number of words, the hit ranges of words (rows of first, end), and the sorted ids of items with a match."""
    codes, built, stretch = scanner
    w = normal_words(text)
    matches = []
    if w and built is not None:
        get = codes.get
        coded = "".join([get(x, OTHER) for x in w])
        for part in stretch.finditer(coded):
            matches += [(part.start() + at, value) for at, value in built.iter(part.group())]
    if not matches:
        return len(w), np.zeros((0, 2), np.int64), []
    end = (np.array([m[0] for m in matches]) + 1) // CODE
    a, b = K.merged(end - np.array([m[1][0] for m in matches]), end)
    return len(w), np.stack([a, b], axis=1), sorted({x for m in matches for x in m[1][1]})


def original(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Character offsets of word ranges in the text that was normalised."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = K.words(data, np.array([0, len(data)]), ~KEEP)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [{"start": int(chars[start[a]]), "end": int(chars[end[b - 1]])} for a, b in hit]


def _scanner(shared: Broadcast, text: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = automaton(shared)
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for value in batch.column(text).to_pylist():
                n, hit, ids = scan(scanner, value)
                n_words.append(n)
                n_hit.append(int((hit[:, 1] - hit[:, 0]).sum()))
                items.append(ids)
                spans.append(original(value, hit) if len(hit) else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            extra = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids as strings) and spans (hit character ranges of the original text).

    A name that docs has already is lengthened.
    """
    spark = docs.sparkSession
    asked = pieces_of(items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")), window)
    nodes = asked.agg(F.sum(F.size("w") * window * CODE)).first()[0] or 0
    passes = max(1, -(-nodes // MOST_NODES))
    asked = asked.select("i", F.array_join("w", " ").alias("t"))
    share = lambda part: spark.sparkContext.broadcast((uuid.uuid4().hex, *patterns([tuple(r) for r in part.collect()], window)))
    extra = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", SPAN)]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(free_name(docs, n), t) for n, t in extra)])
    if passes == 1:
        return docs.mapInArrow(_scanner(share(asked), docs.columns.index(text_col), schema.names), schema)
    # an unlucky pass holds more than its share, but pieces are small beside it
    numbered = written(asked.withColumn("pass", F.pmod(F.xxhash64("i", "t"), F.lit(passes))))
    key = free_name(docs, "_key")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()))
    found = None
    for p in range(passes):
        hits = written(rows.select(key, text_col).mapInArrow(_finder(share(numbered.filter(F.col("pass") == p).select("i", "t"))), HITS))
        found = hits if found is None else found.unionByName(hits)
    whole = found.groupBy(F.col("key").alias(key)).agg(F.flatten(F.collect_list("a")).alias("_a"), F.flatten(F.collect_list("b")).alias("_b"), F.flatten(F.collect_list("ids")).alias("_ids"))
    spare = [free_name(rows, n) for n in ("_a", "_b", "_ids")]
    joined = rows.join(whole.select(key, *(F.col(n).alias(x) for n, x in zip(("_a", "_b", "_ids"), spare, strict=True))), key, "left").select(*docs.columns, *spare)
    return joined.mapInArrow(_together(docs.columns.index(text_col), len(docs.columns), schema.names), schema)


HITS = "key long, a array<long>, b array<long>, ids array<string>"


def pieces_of(items: DataFrame, window: int) -> DataFrame:
    """(i, w) of (i, t): the words of each item; long ones in pieces that share window - 1 words, so that no window is lost."""
    low = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select("i", F.regexp_extract_all(low, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), 0).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)), F.lit(PIECE_WORDS))
    return words.select("i", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(PIECE_WORDS + window - 1)))).alias("w"))


def _finder(shared: Broadcast):
    """(key, text) to HITS, of the texts with a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = automaton(shared)
        for batch in batches:
            rows = [(key, *scan(scanner, value)[1:]) for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [r for r in rows if len(r[1])]
            if rows:
                columns = [[r[0] for r in rows], [r[1][:, 0].tolist() for r in rows], [r[1][:, 1].tolist() for r in rows], [r[2] for r in rows]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "a", "b", "ids"])

    return run


def _together(text: int, at: int, names: list[str]):
    """Rows with the word ranges and items of all passes to what _scanner gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for value, a, b, ids in zip(batch.column(text).to_pylist(), *(batch.column(at + i).to_pylist() for i in range(3)), strict=True):
                hit = np.stack(K.merged(np.array(a or [], np.int64), np.array(b or [], np.int64)), axis=1)
                n_words.append(len(normal_words(value)))
                n_hit.append(int((hit[:, 1] - hit[:, 0]).sum()))
                items.append(sorted(set(ids or [])))
                spans.append(original(value, hit) if len(hit) else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            extra = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *extra], names=names)

    return run
