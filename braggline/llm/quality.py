"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network.

Each word has two tokens: itself, where the training sample knows it, and its shape (runs of letters, digits and
other characters, and whether it repeats the word before). Every token has a fixed sparse random index vector;
its random-indexing vector sums the index vectors of its neighbours over the sample. A document is the mean of
its words' vectors and of its shapes' vectors; a two-layer network gives a logit, which a temperature, fitted on
sample texts the network didn't see, turns into a probability.

The model is fitted on the driver from a bounded sample (``SAMPLE`` texts of each label, of at most ``LONGEST``
characters); only it is shipped; whole texts are scored. Null texts are empty and score as a document without
words. Without both labels in the sample every score is the share of label 1. Repeated rows get equal scores;
null ids are not held out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import class_weights, labelled
from .words import SAME, plain, slices, words

SAMPLE, LONGEST = 1500, 20_000
THRESHOLD = 0.3
DIMENSIONS, NON_ZERO, REACH = 32, 6, 2
VOCABULARY, LEAST_COUNT = 20_000, 3
HIDDEN, EPOCHS, BATCH, RATE = 24, 60, 64, 0.01
REMEMBERED = 400_000
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """Runs of small letters, capitals and digits become a, A and 0; other characters stay, three at most in a row. A shape is a
    class of words, told by the first 12 characters of that pattern, so that long strings of odd characters (addresses, code)
    share classes instead of having one each; the word itself is a token of its own, whole."""
    s = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub(lambda m: "A" if len(m[0]) == 1 else "AA", word)))
    return re.sub(r"(.)\1{2,}", r"\1\1\1", s)[:12]


def index_vector(token: str) -> np.ndarray:
    """Sparse ternary, the same for a token everywhere."""
    import xxhash

    r = np.random.default_rng(xxhash.xxh64_intdigest(token.encode("utf-8", "replace")))
    v = np.zeros(DIMENSIONS, np.float32)
    v[r.choice(DIMENSIONS, NON_ZERO, replace=False)] = r.choice([-1, 1], NON_ZERO)
    return v


@dataclass
class Model:
    word_ids: dict[str, int]
    word_vectors: np.ndarray
    shape_contexts: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    share: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _tables(self) -> None:
        """Vectors of what the texts so far held; row 0 stands for words the sample doesn't know."""
        self._seen: dict[str, tuple[int, int]] = {}
        self._shapes: dict[str, int] = {}
        self._matrix = np.zeros((1 << 10, DIMENSIONS), np.float32)

    def _shape_id(self, s: str) -> int:
        """Of a shape; the same one repeated stands right after it."""
        if (i := self._shapes.get(s)) is None:
            i = self._shapes[s] = 2 * len(self._shapes)
            if i + 2 > len(self._matrix):
                self._matrix = np.concatenate([self._matrix, np.zeros_like(self._matrix)])
            for j, t in enumerate((s, "=" + s)):
                self._matrix[i + j] = index_vector(t) + self.shape_contexts.get(t, 0)
        return i

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """(rows, 2 * DIMENSIONS + 1): mean shape vector, mean word vector, log of the number of words."""
        texts = plain(texts)
        if not hasattr(self, "_seen") or len(self._seen) > REMEMBERED or len(self._shapes) > REMEMBERED // 4:
            self._tables()
        out = np.zeros((len(texts), 2 * DIMENSIONS + 1), np.float32)
        for i, j in slices(texts):
            w = words(texts[i:j], fold=SAME)
            n = np.diff(w.first)
            out[i:j, -1] = np.log1p(n)
            has = np.flatnonzero(n)
            if not len(has):
                continue
            coded = w.strings().dictionary_encode()
            seen, ids = self._seen, []
            for x in coded.dictionary.to_pylist():
                if (both := seen.get(x)) is None:
                    both = seen[x] = (self._shape_id(shape(x)), self.word_ids.get(x, 0))
                ids.append(both)
            ids = np.array(ids, np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False)
            again = np.zeros(len(code), np.int64)
            again[1:] = code[1:] == code[:-1]
            again[w.first[:-1][has]] = 0
            starts = w.first[:-1][has]
            out[i + has, :DIMENSIONS] = np.add.reduceat(self._matrix[ids[code, 0] + again], starts, axis=0) / n[has, None]
            out[i + has, DIMENSIONS:-1] = np.add.reduceat(self.word_vectors[ids[code, 1]], starts, axis=0) / n[has, None]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.share)
        return probability(logits((self.pooled(texts) - self.mean) / self.scale, self.layers) / self.temperature)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logits(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> np.ndarray:
    a, b, c, d = layers
    return np.tanh(x @ a + b) @ c + d[0]


def contexts(rows: list[list[str]], index: dict[str, int]) -> np.ndarray:
    """Random-indexing vectors of unit length: sums of neighbours' index vectors, over all rows."""
    base = np.stack([index_vector(t) for t in index]) if index else np.zeros((0, DIMENSIONS), np.float32)
    base = np.concatenate([base, np.zeros((1, DIMENSIONS), np.float32)])
    out = np.zeros_like(base)
    for row in rows:
        ids = np.fromiter((index.get(t, len(index)) for t in row), np.int64, len(row))
        for d in range(1, min(REACH, len(ids) - 1) + 1):
            np.add.at(out, ids[d:], base[ids[:-d]])
            np.add.at(out, ids[:-d], base[ids[d:]])
    out = out[:-1]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on the weighted log loss, with a little weight decay."""
    r = np.random.default_rng(seed)
    p = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for i in range(0, len(x), BATCH):
            at = order[i : i + BATCH]
            h = np.tanh(x[at] @ p[0] + p[1])
            e = weight[at] * (probability(h @ p[2] + p[3][0]) - y[at]) / len(at)
            back = e[:, None] * p[2] * (1 - h * h)
            grads, t = [x[at].T @ back, back.sum(0), h.T @ e, e.sum(keepdims=True)], t + 1
            for k, g in enumerate(grads):
                g = g + 1e-3 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def fit_temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least weighted log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [-(weight * np.where(y == 1, np.log(probability(z / t)), np.log(1 - probability(z / t)))).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(good: list[str], bad: list[str], share: float) -> Model:
    nothing = Model({}, np.zeros((1, DIMENSIONS), np.float32), {}, np.zeros(1), np.ones(1), (), 1.0, share)
    if len(good) < 4 or len(bad) < 4:
        return nothing
    rows = [t.split() for t in good + bad]
    counts = Counter(w for row in rows for w in row)
    index = {w: i for i, (w, n) in enumerate(counts.most_common(VOCABULARY)) if n >= LEAST_COUNT}
    shapes = [[("=" if i and row[i - 1] == w else "") + shape(w) for i, w in enumerate(row)] for row in rows]
    shape_counts = Counter(s for row in shapes for s in row)
    shape_index = {s: i for i, (s, n) in enumerate(shape_counts.most_common(VOCABULARY)) if n >= LEAST_COUNT}
    vectors = np.concatenate([np.zeros((1, DIMENSIONS), np.float32), contexts(rows, index)]).astype(np.float32)
    shape_vectors = contexts(shapes, shape_index)
    model = Model({w: i + 1 for w, i in index.items()}, vectors, {s: shape_vectors[i] for s, i in shape_index.items()}, np.zeros(1), np.ones(1), (), 1.0, share)
    x = model.pooled(pa.array(good + bad, pa.large_string()))
    y = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    seen = np.arange(len(y)) % 4 != 3
    model.mean, model.scale = x[seen].mean(0), x[seen].std(0) + 1e-6
    x = (x - model.mean) / model.scale
    weight = class_weights(y, min(max(share, 0.01), 0.99))
    model.layers = train_network(x[seen], y[seen], weight[seen])
    model.temperature = fit_temperature(logits(x[~seen], model.layers), y[~seen], weight[~seen])
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = SAMPLE, longest: int = LONGEST, text: str = "text", key: str = "doc_id") -> Model:
    return train(*labelled(docs, labels, label, learn, sample, longest, text, key))


def scored(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = shipped.value.score(batch.column(2)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"`{key}` long, held_out boolean, score double, predicted int")
