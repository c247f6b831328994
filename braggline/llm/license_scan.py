"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates are put into classes by size: class c holds those of up to 2**c shingles. For each class a text is cut
into windows of 2**(c + 1) shingles that overlap by half, so that some window holds any template of the class
whole and their Jaccard similarity is a quarter at least. Every hash function is a band of its own: with 48 bands
such a window and its template share one with a probability of 1 - 0.75**48, all but one in a million. Retrieved
templates are verified by the exact share of their distinct shingles that the window and its neighbours' overlap
hold, 0.75 or more. In such a window the place of a template is the stretch of its length, a quarter more allowed for
insertions, that holds most of its shingles; it is taken out and the rest is looked at again. Of places of one
template that overlap, those that hold most stay.

Words are folded to lower case (A-Z) and parted at white space and ASCII punctuation; a template with fewer than five
words is found where exactly its words stand. Templates are a parameter; they go to the executors in lots of
``TEMPLATES_A_LOT``, whose results are put together, so that any number is allowed. Null or empty texts and empty
tables give no matches; very long texts are handled in memory that follows the text; repeated rows are reported as
often as they occur; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .words import PUNCTUATION, mix, plain, shingle_sequence, shingle_set, shingles, slices, words

K, BANDS, THRESHOLD = 5, 48, 0.75
TEMPLATES_A_LOT = 5000
#: Length of a place against its template's.
STRETCH = 1.25


def densest(at: np.ndarray, shingle: np.ndarray, width: int) -> tuple[int, int]:
    """First and last (exclusive) of the hits at sorted places that lie within ``width`` places and hold most distinct
    shingles; the shortest and then the first of equals."""
    held: dict[int, int] = {}
    best, out, first = (0, 0), (0, 0), 0
    places, values = at.tolist(), shingle.tolist()
    for last, (p, x) in enumerate(zip(places, values, strict=True)):
        held[x] = held.get(x, 0) + 1
        while p - places[first] >= width:
            held[values[first]] -= 1
            if not held[values[first]]:
                del held[values[first]]
            first += 1
        # what is held again later adds nothing at the front
        while held[values[first]] > 1:
            held[values[first]] -= 1
            first += 1
        if (value := (len(held), places[first] - p)) > best:
            best, out = value, (first, last + 1)
    return out


class Templates:
    def __init__(self, templates: dict[str, str]):
        w = words(plain(pa.array(list(templates.values()), pa.large_string())), PUNCTUATION)
        h = w.hashes()
        sets = [shingle_set(h[a:b], K) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        named = [(n, s, int(b - a)) for n, s, a, b in zip(templates, sets, w.first[:-1], w.first[1:], strict=True) if len(s)]
        self.names, self.sets = [n for n, *_ in named], [s for _, s, _ in named]
        self.words = [n for *_, n in named]
        kind = [max(0, int(np.ceil(np.log2(len(s))))) if n >= K else -1 for s, n in zip(self.sets, self.words, strict=True)]
        with np.errstate(over="ignore"):
            self.a = (mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1))
            self.b = mix(np.arange(BANDS + 1, 2 * BANDS + 1, dtype=np.uint64))
            # by class: for each band the sorted least values of its templates, and the templates
            self.classes = {}
            for c in sorted(set(kind) - {-1}):
                of = np.array([i for i, k in enumerate(kind) if k == c])
                least = np.array([[(self.sets[i] * a + b).min() for i in of] for a, b in zip(self.a, self.b, strict=True)], np.uint64)
                order = np.argsort(least, axis=1, kind="stable")
                # and which first bits the least values of any band have, as most windows have none of them
                listed = np.zeros(1 << 20, bool)
                listed[(least >> np.uint64(44)).astype(np.int64)] = True
                self.classes[c] = (np.take_along_axis(least, order, axis=1), of[order], listed)
        # by number of words: sorted hashes of whole short templates
        self.short = {n: dict(sorted((int(self.sets[i][0]), i) for i in range(len(self.sets)) if self.words[i] == n)) for n in set(self.words) if n < K}

    def retrieved(self, x: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per class: (window, template) pairs that share a band over one row of shingles; window i begins at i * 2**c."""
        if not len(x):
            return {}
        found: dict[int, list[np.ndarray]] = {c: [] for c in self.classes}
        none = np.array([np.iinfo(np.uint64).max], np.uint64)
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                value = x * self.a[band] + self.b[band]
                done, block = 0, value
                for c, (least, of, listed) in self.classes.items():
                    while done < c:  # halve: least of every two blocks
                        block = np.minimum(block[0::2], np.append(block[1::2], none[: len(block) % 2]))
                        done += 1
                    window = np.minimum(block, np.append(block[1:], none))
                    at = np.flatnonzero(listed[(window >> np.uint64(44)).astype(np.int64)])
                    lo, hi = np.searchsorted(least[band], window[at], "left"), np.searchsorted(least[band], window[at], "right")
                    for i in np.flatnonzero(hi > lo):
                        for t in of[band][lo[i] : hi[i]]:
                            found[c].append((at[i], t))
        return {c: np.unique(np.array(v, np.int64), axis=0) for c, v in found.items() if v}

    def places(self, at: np.ndarray, x: np.ndarray, t: int) -> list[tuple[float, int, int]]:
        """(containment, first shingle, last shingle) of a template in a stretch of text whose hits are x at ``at``."""
        size, width, out = len(self.sets[t]), int(STRETCH * self.words[t]) + 1, []
        while len(at) and len(np.unique(x)) >= THRESHOLD * size:
            first, last = densest(at, x, width)
            share = len(np.unique(x[first:last])) / size
            if share < THRESHOLD:  # wider than the stretch by insertions
                first, last, share = 0, len(at), len(np.unique(x)) / size
            out.append((share, int(at[first]), int(at[last - 1])))
            at, x = np.delete(at, slice(first, last)), np.delete(x, slice(first, last))
        return out

    def find(self, texts: pa.Array):
        """(row, template, first word, words, containment) over an array of texts."""
        texts = plain(texts)
        for i, j in slices(texts):
            w = words(texts[i:j], PUNCTUATION)
            h = w.hashes()
            x = shingles(h, K)
            doc = np.repeat(np.arange(j - i), np.diff(w.first))
            whole = doc[: len(x)] == doc[K - 1 : K - 1 + len(x)]
            best: dict[tuple[int, int], set[tuple[float, int, int]]] = {}
            for c, pairs in self.retrieved(x).items():
                for window, t in pairs.tolist():
                    # a quarter of the window's length to either side, so that edits can't push a template out
                    a, b = max(0, (window << c) - (1 << max(0, c - 1))), min(len(x), (window + 2 << c) + (1 << max(0, c - 1)))
                    hit = np.flatnonzero(whole[a:b] & np.isin(x[a:b], self.sets[t])) + a
                    for d in np.unique(doc[hit]).tolist():
                        at = hit[doc[hit] == d]
                        for share, first, last in self.places(at, x[at], t):
                            best.setdefault((d, t), set()).add((share, int(first - w.first[d]), int(last - first) + K))
            for n, known in self.short.items():
                y = shingle_sequence(h, n)
                for at in np.flatnonzero(np.isin(y, np.array(list(known), np.uint64)) & (doc[: len(y)] == doc[n - 1 : n - 1 + len(y)])).tolist():
                    d = int(doc[at])
                    best.setdefault((d, known[int(y[at])]), set()).add((1.0, int(at - w.first[d]), n))
            for (d, t), hits in sorted(best.items()):
                kept: list[tuple[int, int, float]] = []
                for share, first, n in sorted(hits, key=lambda s: (-s[0], s[2], s[1])):
                    if all(first >= f + m or first + n <= f for f, m, _ in kept):
                        kept.append((first, n, share))
                for first, n, share in sorted(kept):
                    yield i + d, t, first, n, share


def scan(docs: DataFrame, templates: dict[str, str] = TEXTS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per place where a template stands: key, license, first_word, n_words, containment."""
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    names, out = list(templates), None
    for lot in range(0, max(1, len(names)), TEMPLATES_A_LOT):
        shipped = docs.sparkSession.sparkContext.broadcast(Templates({n: templates[n] for n in names[lot : lot + TEMPLATES_A_LOT]}))

        def run(batches, shipped=shipped):
            model = shipped.value
            for batch in batches:
                found = list(model.find(batch.column(1)))
                row, t, first, n, share = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array([model.names[x] for x in t], pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())], names=[key, "license", "first_word", "n_words", "containment"])

        one = source.mapInArrow(run, f"`{key}` long, license string, first_word long, n_words long, containment double")
        out = one if out is None else out.unionByName(one)
    return out
