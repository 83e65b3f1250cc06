"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence's score is logistic in the sum of the weights of its hashed features: lower-cased words, and their first
3 to 8 bytes. Features whose presence in a document doesn't go with the label (a z score under `least_z`, so
that chance passes none among a million) weigh nothing. A document is toxic if any sentence is: P = 1 - prod(1 - p).
Only document labels are needed, and the trained sentence scores locate the offending sentences. Sentences end at
. ! ? or a line break.

Defined results: a null or wordless text has one empty sentence, so it scores as the bias says; rows without a
label or an id aren't learned; without labelled rows of both kinds every score is the share of toxic rows (0 when
there are none). Training reads at most `sample` labelled rows, those of least id hash, of texts of up to `longest`
bytes as many as `sample_bytes` hold, and gives weights to at most `most_features` features, those of the largest z.
The sample keeps the share of the labels, which the bias needs. Scoring reads every text whole, in parallel, with
weights of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import bounded, free_name
from .langid import folded

BITS = 22
SAMPLE, SAMPLE_BYTES, LONGEST = 8000, 16 << 20, 256 << 10
PREFIXES = (3, 4, 5, 6, 7, 8)
LEAST_Z, MOST_FEATURES = 4.0, 4096
STOP = np.isin(np.arange(256), [0x0A, 0x21, 0x2E, 0x3F])
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[0x20] = True


class Bags:
    """Features of a block of texts: (feature, sentence) pairs in text order, and each row's sentences."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = folded(data)
        start, end, rows = K.words(low, offsets, NOT_LETTER)
        n_rows = len(offsets) - 1
        stops = np.concatenate([[0], np.cumsum(STOP[data])])
        row = np.repeat(np.arange(n_rows), np.diff(rows))
        new = np.ones(len(start), bool)
        new[1:] = (stops[start[1:]] != stops[start[:-1]]) | (row[1:] != row[:-1])
        sentence = np.cumsum(new) - 1
        # a row without words has one sentence without features
        bare = np.flatnonzero(np.diff(rows) == 0)
        count = int(sentence[-1]) + 1 if len(sentence) else 0
        self.sentences = count + len(bare)
        self.row = np.concatenate([row[new], bare])
        first = np.flatnonzero(new)
        self.begin = np.concatenate([start[first], offsets[bare]])
        last = np.append(first[1:] - 1, len(start) - 1) if len(first) else first
        self.end = np.concatenate([end[last], offsets[bare]])
        rolling = K.Rolling(low)
        word = rolling.ranges(start, end)
        parts = [word]
        for i, p in enumerate(PREFIXES):
            parts.append(rolling.ranges(start, np.minimum(start + p, end)) ^ K.U64(i + 1))
        # a word that is no longer than a prefix has it only once, as the word
        short = [np.ones(len(word), bool), *(end - start > p for p in PREFIXES)]
        self.feature = np.concatenate([(f[s] >> K.U64(64 - BITS)).astype(np.int32) for f, s in zip(parts, short, strict=True)])
        self.of = np.concatenate([sentence[s].astype(np.int32) for s in short])

    def keep(self, number: np.ndarray) -> None:
        """Only features with a number, which replaces them."""
        n = number[self.feature]
        held = n >= 0
        self.feature, self.of = n[held], self.of[held]

    def sums(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.of, weights[self.feature], self.sentences) + bias


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Model:
    """features: the buckets that weigh something, sorted; weights: theirs."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float, scale: tuple[float, float] = (1.0, 0.0)) -> None:
        self.features, self.weights, self.bias, self.scale = features, weights, bias, scale

    def numbers(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.features] = np.arange(len(self.features))
        return out

    def sentences(self, bags: Bags) -> np.ndarray:
        """-log(1 - p) of each sentence, for bags that keep() was called on."""
        return softplus(bags.sums(self.weights, self.bias))

    def odds(self, bags: Bags, rows: int) -> np.ndarray:
        return np.log(np.expm1(np.clip(np.bincount(bags.row, self.sentences(bags), rows), 1e-12, 500)))

    def documents(self, bags: Bags, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.odds(bags, rows) + self.scale[1], -500, 500)))


def _blocks(texts: list[str]) -> Iterator[tuple[Bags, int, int]]:
    body = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in body])])
    data = np.frombuffer(b"".join(body), np.uint8)
    for i, j in K.blocks(offsets):
        yield Bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), i, j


def _associated(texts: list[str], y: np.ndarray, least_z: float, most: int) -> np.ndarray:
    """Buckets whose presence in a document goes with the label, at most `most`, strongest first kept; sorted."""
    with_, toxic = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    for bags, i, _ in _blocks(texts):
        row = bags.row[bags.of].astype(np.int64)
        pair = np.unique((row << BITS) | bags.feature)
        f, label = pair & ((1 << BITS) - 1), y[i + (pair >> BITS)]
        np.add.at(with_, f, 1)
        np.add.at(toxic, f, label.astype(np.float32))
    n, share = len(y), y.mean()
    spread = np.sqrt(np.maximum(with_ * share * (1 - share) * (1 - with_ / n), 1e-9))
    z = (toxic - with_ * share) / (spread + 0.5)
    z[with_ < 3] = 0
    found = np.flatnonzero(z >= least_z)
    return np.sort(found[np.argsort(-z[found], kind="stable")][:most])


def _gathered(texts: list[str], number: np.ndarray) -> Bags:
    """The bags of all texts, with numbered features only."""
    out, feature, of, row, n = None, [], [], [], 0
    for bags, i, _ in _blocks(texts):
        bags.keep(number)
        feature.append(bags.feature)
        of.append(bags.of + n)
        row.append(bags.row + i)
        n += bags.sentences
        out = bags
    out.feature, out.of, out.row, out.sentences = np.concatenate(feature), np.concatenate(of), np.concatenate(row), n
    return out


def _gradient(bags: Bags, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the negative log likelihood of noisy-or, both labels weighing the same: by the features' weights, and by the bias. z: the sentences' logits."""
    share = y.mean()
    total = np.clip(np.bincount(bags.row, softplus(z), len(y)), 1e-9, 50)
    pull = np.where(y > 0, -0.5 / share / np.expm1(total), 0.5 / (1 - share)) / len(y)
    dz = pull[bags.row] / (1 + np.exp(-np.clip(z, -50, 50)))
    return np.bincount(bags.feature, dz[bags.of]), dz.sum()


def _descend(bags: Bags, y: np.ndarray, features: int, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Noisy-or likelihood, both labels weighing the same, by adaptive gradient steps; weights stay positive, as evidence is."""
    share = y.mean()
    w, bias = np.zeros(features), float(np.log(share / (1 - share)) - np.log(max(1.0, bags.sentences / len(y)))) - 1
    mean, square, m0, s0 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, epochs + 1):
        g, g0 = _gradient(bags, y, bags.sums(w, bias))
        g = np.append(g, np.zeros(features - len(g))) + decay * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        m0, s0 = 0.9 * m0 + 0.1 * g0, 0.99 * s0 + 0.01 * g0 * g0
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = np.maximum(w - rate * fix * mean / (np.sqrt(square) + 1e-8), 0)
        bias -= rate * fix * m0 / (np.sqrt(s0) + 1e-8)
    return w, bias


def _trained(texts: list[str], y: np.ndarray, epochs: int, rate: float, decay: float, most: int) -> Model:
    features = _associated(texts, y, LEAST_Z, most)
    model = Model(features, np.zeros(len(features)), 0.0)
    bags = _gathered(texts, model.numbers())
    model.weights, model.bias = _descend(bags, y, len(features), epochs, rate, decay)
    return model


def fit(texts: list[str], labels: list[int], epochs: int = 200, rate: float = 0.2, decay: float = 1e-6, threshold: float = 0.7, most_features: int = MOST_FEATURES) -> Model:
    """Trains on four fifths, and shifts the log odds so that `threshold` is the best cut on the other fifth; then trains on all."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0, (0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9)))))
    hold = np.arange(len(y)) % 5 == 0
    shift = 0.0
    if min(y[hold].sum(), (1 - y[hold]).sum(), y[~hold].sum(), (1 - y[~hold]).sum()) > 0:
        inner = _trained([t for t, h in zip(texts, hold, strict=True) if not h], y[~hold], epochs, rate, decay, most_features)
        n = int(hold.sum())
        odds = inner.odds(_gathered([t for t, h in zip(texts, hold, strict=True) if h], inner.numbers()), n)
        order = np.argsort(-odds, kind="stable")
        hit = np.cumsum(y[hold][order])
        f1 = 2 * hit / (np.arange(1, n + 1) + y[hold].sum())
        best = int(f1.argmax())
        shift = float(np.log(threshold / (1 - threshold)) - (odds[order[best]] + odds[order[min(best + 1, n - 1)]]) / 2)
    model = _trained(texts, y, epochs, rate, decay, most_features)
    model.scale = (1.0, shift)
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, longest: int = LONGEST, most_features: int = MOST_FEATURES) -> Model:
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.coalesce(F.octet_length(text_col), F.lit(0)) <= longest))
    texts, labels, size = [], [], 0
    for r in bounded(rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")), "i", sample):
        size += len((r["t"] or "").encode())
        if size > sample_bytes:
            break
        texts.append(r["t"] or "")
        labels.append(int(r["y"] > 0))
    return fit(texts, labels, most_features=most_features)


def _scorer(model: Model, text: int, names: list[str], locate: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = model.numbers()
        for batch in batches:
            data, offsets = K.buffers(batch.column(text))
            scores, found = np.zeros(batch.num_rows), []
            for i, j in K.blocks(offsets):
                body = data[offsets[i] : offsets[j]]
                bags = Bags(body, offsets[i : j + 1] - offsets[i])
                bags.keep(number)
                scores[i:j] = model.documents(bags, j - i)
                if locate is not None:
                    p = -np.expm1(-model.sentences(bags))
                    spans: list[list[dict]] = [[] for _ in range(j - i)]
                    for s in np.flatnonzero(p >= locate).tolist():
                        a, b = int(bags.begin[s]), int(bags.end[s])
                        spans[bags.row[s]].append({"text": body[a:b].tobytes().decode(), "score": float(p[s])})
                    found += spans
            columns = [*batch.columns, pa.array(scores)]
            if locate is not None:
                columns.append(pa.array(found, pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", locate: float | None = None) -> DataFrame:
    """docs with toxicity and, with `locate`, toxic_sentences (text and score of each sentence that scores as much). A name in use is lengthened."""
    extra = [("toxicity", T.DoubleType())]
    if locate is not None:
        extra.append(("toxic_sentences", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())]))))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(free_name(docs, n), t) for n, t in extra)])
    return docs.mapInArrow(_scorer(model, docs.columns.index(text_col), schema.names, locate), schema)
