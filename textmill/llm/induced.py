"""Suffix array and common-prefix values by induced sorting with queues that spill.

S*-suffixes (a descent before, an ascent after) are sorted by recursion on the sequence of their names; from them
all L-type and then all S-type suffixes are induced, bucket by bucket. Induced tuples (position, common prefix with
the tuple before) wait in a priority queue whose keys are the first characters; the least (or largest) key is popped
in bulk and its predecessors are pushed, so every step is a vector operation over a whole bucket. With a folder, queues
spill their oldest chunks to it beyond `memory` bytes, and some arrays as long as the text are files there. What has
left a queue, the hashes, the types and the doubling stay in memory, some 70 bytes for one of the text: whoever makes
a shard bounds its size (`suffix_dedup` does).

The common prefix of two induced neighbours is one more than the least common prefix between the suffixes that
induced them; the queue keeps that minimum per key. Values are capped at `depth`, and suffixes that agree that far
may stand in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

from . import kernels as K

END, SEPARATOR, SHIFT = 0, 1, 2
SMALL_ALPHABET = 1024


class Store:
    """Arrays in memory, or in files of a folder under `root`, if there is one, once they are large."""

    def __init__(self, memory: int, root: str | None) -> None:
        self.memory, self.root, self.folder, self.files = memory, root, None, 0

    def path(self) -> str:
        if self.folder is None:
            os.makedirs(self.root, exist_ok=True)
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=self.root)
        self.files += 1
        return f"{self.folder}/{self.files}"

    def array(self, n: int, kind: type) -> np.ndarray:
        if self.root is None or n * np.dtype(kind).itemsize <= self.memory // 8 or not n:
            return np.zeros(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None


class BulkQueue:
    """Priority queue of (position, common prefix) tuples with small integer keys; equal keys leave in the order they came."""

    def __init__(self, store: Store) -> None:
        self.store, self.waiting, self.held = store, {}, 0

    def push(self, key: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.waiting.setdefault(key, []).append((position, prefix))
        self.held += position.nbytes + prefix.nbytes
        if self.store.root and self.held > self.store.memory:
            self._spill()

    def _spill(self) -> None:
        for chunks in self.waiting.values():
            for i, chunk in enumerate(chunks):
                if not isinstance(chunk, str):
                    path = self.store.path() + ".npz"
                    np.savez(path, position=chunk[0], prefix=chunk[1])
                    chunks[i] = path
        self.held = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of a key, or None."""
        chunks = self.waiting.pop(key, None)
        if not chunks:
            return None
        out = []
        for chunk in chunks:
            if isinstance(chunk, str):
                with np.load(chunk) as f:
                    out.append((f["position"], f["prefix"]))
                os.unlink(chunk)
            else:
                out.append(chunk)
                self.held -= chunk[0].nbytes + chunk[1].nbytes
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last], both included."""
    table, width = [values], 1
    longest = int((last - first).max()) + 1 if len(first) else 1
    while 2 * width <= longest:
        below = table[-1]
        table.append(np.minimum(below[:-width], below[width:]))
        width *= 2
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level).tolist():
        here = level == k
        a, b = first[here], last[here] - (1 << k) + 1
        out[here] = np.minimum(table[k][a], table[k][b])
    return out


class Sorter:
    """Sorts the suffixes of `text` (unsigned codes, the last one END and END nowhere else)."""

    def __init__(self, text: np.ndarray, depth: int, memory: int = 256 << 20, folder: str | None = None) -> None:
        self.text, self.depth, self.store = text, depth, Store(memory, folder)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array, common prefix with the suffix before it, capped)."""
        try:
            return self._sorted(self.text)
        finally:
            self.store.close()

    def _types(self, text: np.ndarray) -> np.ndarray:
        """Whether each suffix is S-type, i.e. smaller than the next one."""
        n = len(text)
        out = self.store.array(n, bool)
        rising = text[:-1] < text[1:]
        differs = np.flatnonzero(text[:-1] != text[1:])
        after = np.searchsorted(differs, np.arange(n - 1))  # the end of the run of equal codes decides
        out[:-1] = rising[differs[np.minimum(after, len(differs) - 1)]] & (after < len(differs))
        out[-1] = True
        return out

    def _sorted(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(text) < 3:
            order = np.argsort(text, kind="stable")
            return order, np.zeros(len(text), np.uint8)
        small = self._types(text)
        stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        stars = self._sorted_stars(text, small, stars)
        prefix = self._prefixes(text, stars[:-1], stars[1:])
        return self._induced(text, small, stars, np.concatenate([np.zeros(1, np.uint8), prefix]))

    def _sorted_stars(self, text: np.ndarray, small: np.ndarray, stars: np.ndarray) -> np.ndarray:
        """S*-suffixes in order: their substrings are named by one induction, the sequence of names is sorted by recursion."""
        if len(stars) < 2:
            return stars
        loose = stars[np.argsort(text[stars], kind="stable")]
        order, _ = self._induced(text, small, loose, np.zeros(len(loose), np.uint8))
        is_star = self.store.array(len(text), bool)
        is_star[stars] = True
        order = order[is_star[order]]
        length = np.empty(len(stars), np.int64)
        length[:-1], length[-1] = np.diff(stars) + 1, 1
        at = np.searchsorted(stars, order)
        rolling = K.Rolling(text)
        mark = rolling.ranges(order, order + length[at])
        names = np.zeros(len(stars), np.int64)
        names[at] = np.concatenate([[0], np.cumsum((mark[1:] != mark[:-1]) | (length[at][1:] != length[at][:-1]))])
        if names.max() + 1 == len(stars):
            return order
        if names.max() + 1 <= SMALL_ALPHABET:
            below, _ = Sorter._sorted(self, np.append(names + 1, END).astype(np.uint32))
            return stars[below[1:]]
        return stars[self._doubled(names)]

    def _doubled(self, names: np.ndarray) -> np.ndarray:
        """Order of the suffixes of a sequence over a large alphabet: ranks of doubled length, as deep as `depth` asks."""
        rank, width = names, 1
        while True:
            order = np.argsort(rank, kind="stable")
            if width * 2 > self.depth + 2:  # a name covers two characters or more
                return order
            follows = np.zeros(len(rank), np.int64)
            follows[:-width] = rank[width:] + 1
            both = rank * (len(rank) + 2) + follows
            order = np.argsort(both, kind="stable")
            sorted_ = both[order]
            new = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            rank = np.empty(len(rank), np.int64)
            rank[order] = new
            if new[-1] + 1 == len(rank):
                return order
            width *= 2

    def _prefixes(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes by halving, capped."""
        n, rolling = len(text), K.Rolling(text)
        low, high = np.zeros(len(a), np.int64), np.minimum(self.depth, n - np.maximum(a, b))
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = rolling.ranges(a, a + middle) == rolling.ranges(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low.astype(np.uint8)

    def _pair(self, text: np.ndarray, a: int, b: int) -> int:
        most = min(self.depth, len(text) - max(a, b))
        differs = np.flatnonzero(text[a : a + most] != text[b : b + most])
        return int(differs[0]) if len(differs) else most

    def _induced(self, text: np.ndarray, small: np.ndarray, stars: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.flatnonzero(np.bincount(text))
        star_code = text[stars]
        edges = np.searchsorted(star_code, codes, "left"), np.searchsorted(star_code, codes, "right")
        large: dict[int, list] = {}

        queue, scan = BulkQueue(self.store), _Scan(text, small, self.depth, False)
        for c, lo, hi in zip(codes.tolist(), *(e.tolist() for e in edges), strict=True):
            scan.bucket()
            while (batch := queue.pop(c)) is not None:
                large.setdefault(c, []).append(batch)
                scan.feed(queue, *batch)
            if lo < hi:
                p = prefix[lo:hi].copy()
                p[0] = self._pair(text, int(large[c][-1][0][-1]), int(stars[lo])) if c in large else 0
                scan.feed(queue, stars[lo:hi], p)
        queue, scan = BulkQueue(self.store), _Scan(text, small, self.depth, True)
        done: dict[int, list] = {}
        end = len(text) - 1
        for c in codes[::-1].tolist():
            scan.bucket()
            while (batch := queue.pop(c)) is not None:
                done.setdefault(c, []).append(batch)
                scan.feed(queue, *batch)
            if c == text[end] and c not in done:
                done[c] = [(np.array([end]), np.zeros(1, np.uint8))]
            if c in large:
                position, p = (np.concatenate(x) for x in zip(*large[c], strict=True))
                large[c] = [(position, p)]
                down = np.zeros(len(p), np.uint8)
                down[1:] = p[1:][::-1]
                down[0] = self._pair(text, int(position[-1]), int(done[c][-1][0][-1])) if c in done else 0
                scan.feed(queue, position[::-1], down)
        order, out, at = self.store.array(len(text), np.int64), self.store.array(len(text), np.uint8), 0
        for c in codes.tolist():
            before = None
            if c in large:
                position, p = large[c][0]
                order[at : at + len(position)], out[at : at + len(position)] = position, p
                out[at] = 0
                at += len(position)
                before = int(position[-1])
            if c in done:
                position, p = (np.concatenate(x) for x in zip(*done[c], strict=True))
                n = len(position)
                order[at : at + n] = position[::-1]
                out[at + 1 : at + n] = p[1:][::-1]
                out[at] = 0 if before is None else self._pair(text, before, int(position[-1]))
                at += n
        return order[:at], out[:at]


class _Scan:
    """Pushes the predecessors of scanned suffixes, with the least common prefix since the last push of the same key."""

    def __init__(self, text: np.ndarray, small: np.ndarray, depth: int, down: bool) -> None:
        self.text, self.small, self.depth, self.down = text, small, depth, down
        self.since: dict[int, int] = {}

    def bucket(self) -> None:
        """The next suffix shares nothing with the last."""
        self.since = dict.fromkeys(self.since, 0)

    def feed(self, queue: BulkQueue, position: np.ndarray, prefix: np.ndarray) -> None:
        before = position - 1
        fits = before >= 0
        fits[fits] = self.small[before[fits]] == self.down
        at = np.flatnonzero(fits)
        before = before[at]
        code = self.text[before]
        order = np.argsort(code, kind="stable")
        at, before, code = at[order], before[order], code[order]
        least_so_far = np.minimum.accumulate(prefix)
        lowest = int(least_so_far[-1])
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        value = np.zeros(len(code), np.uint8)
        inner = np.ones(len(code), bool)
        inner[starts] = False
        inner = np.flatnonzero(inner)
        if len(inner):
            value[inner] = np.minimum(least_between(prefix, at[inner - 1] + 1, at[inner]).astype(np.int64) + 1, self.depth)
        keys, ends = code[starts].tolist(), [*starts[1:].tolist(), len(code)][: len(starts)]
        tail = np.minimum.accumulate(prefix[::-1])[::-1]  # least of what follows
        since = {k: min(v, lowest) for k, v in self.since.items()}
        for key, i, j in zip(keys, starts.tolist(), ends, strict=True):
            value[i] = min(min(self.since[key], int(least_so_far[at[i]])) + 1, self.depth) if key in self.since else 0
            queue.push(key, before[i:j], value[i:j])
            last = int(at[j - 1]) + 1
            since[key] = int(tail[last]) if last < len(prefix) else self.depth
        self.since = since
