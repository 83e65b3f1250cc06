"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword of bits. For each bit, one binary classifier (a logistic model over hashed byte
n-grams of the lower-cased text, n = 1..3, mean over the text) tells the languages whose bit is 1 from the others.
Decoding is loss-weighted: a language's loss is the sum over bits of the logistic loss of its bit against the
classifier's margin, each bit weighted by its accuracy on the training rows; the least loss wins. A document is
flagged as ambiguous if its two least losses are closer than AMBIGUOUS times what is usual (the median) among the
training rows of the language that won.

Defined results: `und` with score 0 and ambiguous for null texts and texts without a letter; nulls among the labels
are not learned; equal losses go to the smaller name; with one language nothing else is ambiguous; without any
labelled row every document is `und`. Training uses at most `sample` labelled rows, an equal part for each language
and of these the ones with the least hash of their id, so a language of few rows is learned like the others (the
`sample` most frequent languages, if there are more); of texts of up to `longest` bytes, as many as `sample_bytes`
hold. Prediction reads every text whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import bounded, free_name

BUCKETS = 1 << 12
SAMPLE, SAMPLE_BYTES, LONGEST = 1500, 8 << 20, 128 << 10
ORDERS = (1, 2, 3)
UNKNOWN = "und"
AMBIGUOUS = 0.4


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters lower-cased, and everything that is no letter as a space."""
    out = data.copy()
    upper = (out >= 0x41) & (out <= 0x5A)
    out[upper] += 32
    latin = np.zeros(len(out), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 0x20
    out[(out < 0x61) | ((out > 0x7A) & (out < 0x80))] = 0x20
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: bucket of the n-gram that begins at each byte, and whether it counts (inside its row, not all blank)."""
    text = folded(data).astype(np.uint32)
    n = len(text)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    here = np.arange(n)
    for order in ORDERS:
        if n < order:
            yield np.zeros(0, np.int64), np.zeros(0, bool)
            continue
        code = np.zeros(n - order + 1, np.uint32)
        for j in range(order):
            code = code * np.uint32(257) + text[j : n - order + 1 + j]
        code = (code * np.uint32(2654435761 + order * 2)) >> np.uint32(32 - 12)
        blank = (text[: n - order + 1] == 0x20) & (text[order - 1 :] == 0x20)
        yield code.astype(np.int64), ~blank & (here[: n - order + 1] + order <= row_end[: n - order + 1])


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x (orders * BUCKETS) relative frequencies, for training."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros((len(offsets) - 1, len(ORDERS) * BUCKETS), np.float32)
    for o, (code, counted) in enumerate(features(data, offsets)):
        np.add.at(out, (rows[: len(code)][counted], o * BUCKETS + code[counted]), 1)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def codewords(languages: int) -> np.ndarray:
    """+-1 codewords, one row per language: all splits for up to 5 languages, else a random code of the largest least distance of 200 tries."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(splits, np.int8).T
    rng, bits = np.random.default_rng(5), int(np.ceil(10 * np.log2(languages)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        apart = ((code[:, None] != code[None]).sum(-1) + bits * np.eye(languages, dtype=int)).min()
        if apart > most and (code != code[0]).any(axis=0).all():
            best, most = code, apart
    return best


class Model:
    """Languages, codewords, and per bit a weight for each n-gram bucket."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust
        self.usual = np.zeros(len(languages))  # median gap between the two least losses, by language

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, bits = len(offsets) - 1, self.code.shape[1]
        sums, total = np.zeros((rows, bits)), np.zeros(rows)
        for o, (code, counted) in enumerate(features(data, offsets)):
            if not len(code):
                continue
            shut = np.concatenate([[0], np.cumsum(counted)])
            ends = shut[np.minimum(offsets, len(code))]
            total += np.diff(ends)
            used = code[counted]
            for b in range(bits):
                part = np.concatenate([[0.0], np.cumsum(self.weights[b, o * BUCKETS : (o + 1) * BUCKETS][used], dtype=np.float64)])
                sums[:, b] += part[ends[1:]] - part[ends[:-1]]
        return sums / np.maximum(total, 1)[:, None] + self.bias

    def decoded(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language of least weighted loss, its share of exp(-loss), and how far the next loss is."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(-1)
        best = loss.argmin(axis=1)
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        least = np.partition(loss, 1, axis=1)[:, :2] if loss.shape[1] > 1 else np.tile([0.0, np.inf], (len(loss), 1))
        return best, 1 / e.sum(axis=1), least[:, 1] - least[:, 0]


def fit(texts: list[str], labels: list[str], epochs: int = 60) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    code = codewords(len(languages))
    body = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in body])])
    data = np.frombuffer(b"".join(body), np.uint8)
    x = np.zeros((len(body), len(ORDERS) * BUCKETS), np.float32)
    for i, j in K.blocks(offsets, 1 << 18):
        x[i:j] = counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-4
    x /= scale
    y = code[np.searchsorted(languages, labels)].astype(np.float32)
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    share = np.array([labels.count(v) for v in languages], np.float32)
    row_weight = (1 / share)[np.searchsorted(languages, labels)][:, None]
    row_weight /= row_weight.sum()
    rate = 8.0 / float(np.einsum("ij,ij->", x, x) / len(x))
    for _ in range(epochs):
        pull = row_weight * y / (1 + np.exp(np.clip(y * (x @ w + bias), -30, 30)))
        w += rate * (x.T @ pull)
        bias += 0.5 * pull.sum(axis=0)
    right = (row_weight * (y * (x @ w + bias) > 0)).sum(axis=0)
    model = Model(languages, code, (w / scale[:, None]).T.copy(), bias, np.clip(right, 0.05, 1.0))
    best, _, gap = model.decoded((x @ w + bias).astype(np.float64))
    if len(languages) > 1:
        model.usual = np.array([np.median(gap[best == i]) if (best == i).any() else 0.0 for i in range(len(languages))])
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, longest: int = LONGEST) -> Model | None:
    """Fits on a bounded sample: of each language the rows of least hash, as many as the bounds hold."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"))
    texts, labels, size = [], [], 0
    for r in bounded(rows.filter(F.octet_length("t") <= longest), "i", sample, "l"):
        size += len(r["t"].encode())
        if size > sample_bytes:
            break
        if any(c.isalpha() for c in r["t"]):
            texts.append(r["t"])
            labels.append(r["l"])
    return fit(texts, labels)


def _predictor(model: Model | None, text: int, names: list[str], ambiguous: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            langs, scores, close = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters)), np.ones(len(letters), bool)
            if model:
                data, offsets = K.buffers(batch.column(text))
                names_of = np.array(model.languages, object)
                for i, j in K.blocks(offsets):
                    best, score, gap = model.decoded(model.margins(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                    langs[i:j], scores[i:j], close[i:j] = names_of[best], score, gap < ambiguous * model.usual[best]
                langs[~letters], scores[~letters], close[~letters] = UNKNOWN, 0.0, True
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores), pa.array(close)], names=names)

    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """docs with lang_pred, lang_score and lang_ambiguous (a name in use is lengthened); ambiguous: how small a part of the usual gap is flagged."""
    letters = docs.withColumn(free_name(docs, "_letters"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    extra = [("lang_pred", T.StringType()), ("lang_score", T.DoubleType()), ("lang_ambiguous", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(free_name(docs, n), t) for n, t in extra)])
    return letters.mapInArrow(_predictor(model, docs.columns.index(text_col), schema.names, ambiguous), schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text leaves the remainder `fold`; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
