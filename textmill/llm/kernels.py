"""Vectorised text kernels shared by the corpus operators.

All of them work on the buffers of an Arrow string column, a block of whole documents at a time, so that the
temporary arrays stay within a few MB whatever the batch holds; nothing is converted to Python strings per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
MULTIPLIER_2 = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1

#: Bytes that separate words for whitespace tokenisation: space and \t..\r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if body is None else np.frombuffer(body, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer document is a block of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over all the others."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, multiplier: int = MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """multiplier**i and its inverse, modulo 2**64, for i < n."""
    have = _POWERS.get(multiplier)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        inverse = pow(multiplier, -1, 1 << 64)

        def table(base: int) -> np.ndarray:
            out = np.ones(size, U64)
            done = 1
            while done < size:
                step = U64(pow(base, done, 1 << 64))
                more = min(done, size - done)
                out[done : done + more] = out[:more] * step
                done += more
            return out

        have = _POWERS[multiplier] = (table(multiplier), table(inverse))
        if n > 8 * BLOCK_BYTES:  # one giant document must not keep its tables alive
            _POWERS.pop(multiplier)
    return have[0][:n], have[1][:n]


class Rolling:
    """Hashes of any ranges of a sequence of codes; equal ranges have equal hashes wherever they stand."""

    def __init__(self, codes: np.ndarray, multiplier: int = MULTIPLIER) -> None:
        up, self.down = powers(len(codes) + 1, multiplier)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum((codes.astype(U64) + U64(1)) * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)

    def grams_at(self, start: np.ndarray, k: int) -> np.ndarray:
        """What grams(k) holds at these starts."""
        return mix((self.sums[start + k] - self.sums[start]) * self.down[start])


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in `data` (offsets[0] is 0 and offsets[-1] its length), and each row's first word's index."""
    letter = ~separator[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = letter[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def super_grams(codes: np.ndarray, offsets: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """Runs of consecutive windows of `window` codes that share their least k-gram, for rows of codes.

    A window's least k-gram depends on its content only, so two equal windows always lie in runs with the same
    k-gram, at the same distance from it. Returns, per run: row; first and n (its windows start at
    first .. first + n - 1 of the row); gram (hash of the k-gram); whole (hash of all codes that the run covers).
    """
    n = len(codes)
    empty = {"row": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "gram": np.zeros(0, U64), "whole": np.zeros(0, U64)}
    if n < window:
        return empty
    rolling = Rolling(codes)
    grams = rolling.grams(k)
    bits = U64(max(20, int(n).bit_length()))
    low = (U64(1) << bits) - U64(1)
    least = (grams & ~low) | np.arange(len(grams), dtype=U64)  # the position breaks ties: the leftmost wins
    span, have = window - k + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & low).astype(np.int64)
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - window + 1, 0)
    rows = np.repeat(np.arange(len(lengths)), counts)
    if not len(rows):
        return empty
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    chosen = anchor[starts]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (chosen[1:] != chosen[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(rows)))
    begin = starts[at]
    return {"row": rows[at], "first": begin - offsets[rows[at]], "n": size, "gram": grams[chosen[at]], "whole": rolling.ranges(begin, begin + size - 1 + window)}


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint, maximal ranges that cover what the given ranges cover."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64))
