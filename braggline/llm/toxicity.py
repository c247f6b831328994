"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, window by window.

The ordinary dictionary is cut from random places of ordinary training texts. The toxic one holds the same text, which
both classes share, and before it whole windows of toxic training texts: those that shorten most toxic texts that they
weren't taken from, beyond what ordinary text does, and few ordinary ones. Nothing but compression lengths chooses
them: the toxic texts are parted into two folds; of one fold's windows, those are candidates that the other fold's text
shortens most beyond as much ordinary text, the dictionary so far beside either; each candidate is tried as an addition to it on windows of the other fold and of ordinary
texts; and they are taken one by one, by the share of toxic texts that they shorten where those before them don't, less
``CAUTION`` times the share of ordinary texts, down to a share of ``LEAST``. A further round goes on with
the texts of both folds that the dictionary so far shortens nowhere, so that rarer kinds of toxic text aren't crowded out by frequent ones. A window's gain is its length under the ordinary dictionary
less that under the toxic one. A document's score is a logistic function, calibrated on training texts that didn't
shape the dictionaries, of how many of its windows gain how much. Whole texts are scored, at two window sizes.

The model is fitted on the driver from a bounded sample (``SAMPLE`` texts of each label, of at most ``LONGEST``
characters, ``ROUNDS`` rounds of ``CANDIDATES`` windows of a fold, ``TRIED`` ordinary texts); only it is shipped. Equal candidates are taken in the order of
texts. Null texts are empty; an empty text has no gain and gets the calibrated score of that. Very long texts are
scored window by window, in memory that follows the text. Without any toxic or ordinary sample every score is 0. Repeated
rows get equal scores; null ids are not held out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import class_weights, labelled, logistic
from .worker import cache, trimmed
from .words import plain

SAMPLE, LONGEST = 1500, 20_000
THRESHOLD = 0.3
#: Bytes of a window, and how far it may run on to end at a blank.
SIZES, SLACK = (48, 96), 40
GAINS = (2, 3, 4, 5, 6)
#: Bytes of ordinary text in both dictionaries, and of its pieces.
ORDINARY_BYTES, PIECE = 32_768, 256
#: Bytes of the windows to choose from, how many of a fold are tried in a round, rounds, the ordinary texts that they are tried on, and the bytes of a gain.
CHOICE, CANDIDATES, ROUNDS, TRIED, SAVED = 24, 100, 4, 500, 2
#: Bytes of the other fold that candidates are found by, which with ordinary text are still in the compressor's reach.
REACH = 65_536
#: Weight of ordinary texts that a window shortens, and the least share of toxic texts beyond them.
CAUTION, LEAST = 4.0, 0.025


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def windows(text: str, size: int) -> list[bytes]:
    """The whole text in order, cut at blanks where one is near."""
    b, out, i = text.lower().encode(), [], 0
    n = len(b)
    while i < n:
        j = i + size
        if j < n:
            k = b.find(b" ", j, j + SLACK)
            j = k if k >= 0 else j
        out.append(b[i:j])
        i = j
    return out


def _compressor(content: bytes):
    import zstandard as z

    setting = z.ZstdCompressionParameters.from_level(3, strategy=z.STRATEGY_LAZY2, min_match=5, window_log=17, search_log=5, hash_log=15, chain_log=15, write_content_size=0)
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=setting)
    return z.ZstdCompressor(dict_data=d, compression_params=setting)


def compressor(content: bytes):
    held = cache("toxicity")
    if content not in held:
        if len(held) > 8:
            held.clear()
        held[content] = _compressor(content)
    return held[content]


def features(model: Model, texts: Iterable[str]) -> np.ndarray:
    """Constant, number of windows, and for each window size the sum, the maximum, the mean and the counts of gains."""
    a, b = compressor(model.ordinary).compress, compressor(model.toxic).compress
    rows = []
    for t in texts:
        row = [1.0, math.log1p(len(t))]
        for size in SIZES:
            gain = np.array([len(a(w)) - len(b(w)) for w in windows(t, size)] or [0])
            row += [math.log1p(np.maximum(gain - 1, 0).sum()), float(gain.max()), float(gain.mean()), *(math.log1p(np.count_nonzero(gain >= g)) for g in GAINS)]
        rows.append(row)
    return np.array(rows, float).reshape(-1, 2 + len(SIZES) * (3 + len(GAINS)))


def _lengths(content: bytes, texts: list[bytes]) -> np.ndarray:
    """Of each text, compressed with this dictionary."""
    run = _compressor(content).compress
    return np.array([len(run(t)) for t in texts], np.int64)


def _shortened(texts: list[str], ordinary: bytes, trial: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(windows, each one's text, lengths under ``ordinary``) of the windows that ``trial`` shortens: no part of it shortens others."""
    own = [(k, w) for k, t in enumerate(texts) for w in dict.fromkeys(windows(t, CHOICE))]
    found = [w for _, w in own]
    before = _lengths(ordinary, found)
    keep = np.flatnonzero(before - _lengths(trial, found) >= SAVED)
    return [found[k] for k in keep], np.array([own[k][0] for k in keep], np.int64), before[keep]


def _sampled(texts: list[str], r: np.random.Generator) -> bytes:
    """``REACH`` bytes of the texts' windows, in a random order."""
    known = [w for t in texts for w in windows(t, CHOICE)]
    return b" ".join(known[k] for k in r.permutation(len(known))[: REACH // CHOICE].tolist())[:REACH]


def _left(texts: list[str], ordinary: bytes, base: bytes) -> list[str]:
    """Those of the texts that ``base`` doesn't shorten anywhere."""
    of = set(_shortened(texts, ordinary, base)[1].tolist())
    return [t for k, t in enumerate(texts) if k not in of]


def _chosen(own: list[str], held: list[str], others: list[str], ordinary: bytes, r: np.random.Generator) -> list[bytes]:
    """Windows of the texts ``own`` that shorten texts of ``held``, chosen in rounds, each from the texts that those before leave as they are."""
    usual = _sampled(others, r)
    out: list[bytes] = []
    for _ in range(ROUNDS):
        base = b" ".join([*out, ordinary])
        if out:
            own, held = _left(own, ordinary, base), _left(held, ordinary, base)
        if not own or not held:
            break
        pool = list(dict.fromkeys(w for t in own for w in windows(t, CHOICE)))
        gain = _lengths(usual + b" " + base, pool) - _lengths(_sampled(held, r) + b" " + base, pool)
        out += _round([pool[k] for k in np.argsort(-gain, kind="stable")[:CANDIDATES]], held, others, base)
    return out


def _round(candidates: list[bytes], held: list[str], others: list[str], base: bytes) -> list[bytes]:
    """Those of the candidates that help beyond the dictionary so far, most useful first."""
    all_ = b" ".join([*candidates, base])
    (toxic, of, before), (clean, of_clean, before_clean) = _shortened(held, base, all_), _shortened(others, base, all_)
    saves, harm = [], []
    for c in candidates:
        trial = c + b" " + base
        saves.append(np.flatnonzero(before - _lengths(trial, toxic) >= SAVED))
        harm.append(len(set(of_clean[before_clean - _lengths(trial, clean) >= SAVED].tolist())) / max(1, len(others)))
    times, out, left = np.zeros(len(toxic)), [], list(range(len(candidates)))
    while left:
        worth = []
        for k in left:
            best = np.zeros(len(held))
            np.maximum.at(best, of[saves[k]], 1 / (1 + times[saves[k]]) ** 2)
            worth.append(best.sum() / len(held) - CAUTION * harm[k])
        k = int(np.argmax(worth))
        if worth[k] <= LEAST:
            break
        out.append(candidates[left[k]])
        times[saves[left[k]]] += 1
        left.pop(k)
    return out


def _random_pieces(texts: list[bytes], size: int, piece: int, r: np.random.Generator) -> bytes:
    """``size`` bytes (fewer of little text) from random places of the texts in a random order."""
    out, held = [], 0
    order = r.permutation(len(texts))
    for n in range(4 * (size // piece + 1)):
        t = texts[order[n % len(order)]]
        at = int(r.integers(0, max(1, len(t) - piece)))
        out.append(t[at : at + piece])
        held += len(out[-1]) + 1
        if held >= size:
            break
    return b" ".join(out)[:size]


def dictionaries(toxic: list[str], ordinary: list[str], seed: int = 3) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries of the training texts. What is chosen stands first, where matches cost most: ordinary text is then
    matched in the part that both have."""
    r = np.random.default_rng(seed)
    shared = _random_pieces([t.lower().encode() for t in ordinary], ORDINARY_BYTES, PIECE, r)
    folds, others = (toxic[::2], toxic[1::2]), ordinary[:TRIED]
    own = [w for a, b in (folds, folds[::-1]) for w in _chosen(a, b, others, shared, r)]
    return shared, b" ".join([*own, shared])


def train(toxic: list[str], ordinary: list[str], share: float) -> Model | None:
    """Two thirds of the texts shape the dictionaries, the rest calibrates the score to the share of toxic texts."""
    if len(toxic) < 3 or len(ordinary) < 3:
        return None
    n, m = len(toxic) * 2 // 3, len(ordinary) * 2 // 3
    model = Model(*dictionaries(toxic[:n], ordinary[:m]), ())
    x = features(model, toxic[n:] + ordinary[m:])
    y = np.concatenate([np.ones(len(toxic) - n), np.zeros(len(ordinary) - m)])
    return Model(model.ordinary, model.toxic, tuple(logistic(x, y, class_weights(y, min(max(share, 0.01), 0.99)))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST, text: str = "text", key: str = "doc_id") -> Model | None:
    return train(*labelled(docs, labels, label, learn, sample, longest, text, key))


def score(model: Model | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    out = np.zeros(len(texts))
    texts = plain(texts)
    for i in range(0, len(texts), 256):
        out[i : i + 256] = 1 / (1 + np.exp(-np.clip(features(model, texts[i : i + 256].to_pylist()) @ np.array(model.weights), -30, 30)))
    return out


def scored(docs: DataFrame, model: Model | None, held_out: Column, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every whole text."""

    def run(batches):
        for batch in batches:
            p = score(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(trimmed(run), f"`{key}` long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; nothing is shuffled."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(model, batch.column(at).cast(pa.large_string())) < threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
