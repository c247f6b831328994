"""Benchmark decontamination: SimHash of item-sized windows, found through multi-index Hamming blocks.

Every benchmark item has a 64-bit SimHash of its words. Windows of an item's length are fingerprinted in each
document; the fingerprint is split into blocks, and by pigeonhole any two within ``radius`` differ in at most
``radius // blocks`` bits of some block. Those errors are shared out: the index lists an item's blocks with up to
``LISTED`` bits changed, a window asks for its blocks with up to the rest changed, so that no fingerprint within the
radius is missed. Candidates are verified by the exact weighted similarity of their five-word shingles: the sum of
least counts over the sum of greatest counts, 0.75 or more. A window without any shingle of any item can't pass that,
so such windows aren't fingerprinted.

Words are folded to lower case (A-Z) and parted at white space and ASCII punctuation. The index of at most
``ITEMS_A_PASS`` items (7 KB each) is broadcast; a larger benchmark takes further passes over the documents, one index
at a time, each pass written before the next. An item with fewer than five words has its whole sequence as its
shingle. Very long texts are searched region by region around what they share with items. Null or empty texts, items
and tables give no matches; repeated rows and items are reported as often as they occur; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .worker import cache, trimmed
from .words import PUNCTUATION, mix, plain, shingle_sequence, shingle_set, shingles, slices, words

K, RADIUS, BLOCKS = 5, 15, 4
THRESHOLD = 0.75
#: Changed bits of a block that the index lists; windows ask for the others of RADIUS // BLOCKS.
LISTED = 2
#: Items whose index is shipped at once: 4 blocks x 137 values of 12 bytes each, some 70 MB in all.
ITEMS_A_PASS = 10_000
_WIDTH = 64 // BLOCKS
_BITS = 1 << 20
_REGION = 8192


def masks(most: int) -> np.ndarray:
    """All values of a block with up to ``most`` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(_WIDTH), n)], np.int64)


def bit_sums(h: np.ndarray) -> np.ndarray:
    """(len + 1, 64) running sums of +1 and -1 for the bits of word hashes."""
    bits = np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits * np.int8(2) - np.int8(1), axis=0, dtype=np.int32, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words."""
    return np.ascontiguousarray(np.packbits(sums[size:] - sums[:-size] > 0, axis=1)).view(np.uint64).ravel()


def _counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of a row of words and how often each stands there."""
    return np.unique(shingles(h, K) if len(h) >= K else shingle_set(h, K), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least counts over the sum of greatest counts."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


class Index:
    """Items by block values of their fingerprints, and the shingles of all items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        w = words(plain(pa.array([t for _, t in items], pa.large_string())), PUNCTUATION)
        h = w.hashes()
        hs = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.ids = [i for (i, _), x in zip(items, hs, strict=True) if len(x)]
        hs = [x for x in hs if len(x)]
        self.size = np.array([len(x) for x in hs], np.int64)
        self.sizes = np.unique(self.size)
        self.counts = [_counts(x) for x in hs]
        self.print = np.array([fingerprints(bit_sums(x), len(x))[0] for x in hs], np.uint64)
        keys = [self.keys(self.print, self.size, b)[:, None] ^ masks(LISTED)[None, :] for b in range(BLOCKS)]
        keys = np.concatenate(keys, axis=1) if len(hs) else np.zeros((0, 1), np.int64)
        order = np.argsort(keys.ravel(), kind="stable")
        self.key, self.item = keys.ravel()[order], (order // max(1, keys.shape[1])).astype(np.int32)
        # shingles of the items, by their number of words
        self.gate = {}
        for k in range(1, K + 1):
            of = [x for x in hs if len(x) == k or k == K and len(x) > k]
            if of:
                own = [shingles(x, K) if k == K else shingle_set(x, K) for x in of]
                # the lengths of the items that hold a shingle stand in rows first[i] to first[i + 1] of sizes
                pairs = np.unique(np.stack([np.concatenate(own), np.repeat(np.array([len(x) for x in of], np.uint64), [len(x) for x in own])], axis=1), axis=0)
                known, first = np.unique(pairs[:, 0], return_index=True)
                table = np.zeros(_BITS, bool)
                table[(known >> np.uint64(44)).astype(np.int64)] = True
                self.gate[k] = (known, table, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_listed"}

    @staticmethod
    def _spots(keys: np.ndarray) -> np.ndarray:
        """Places of keys in the table of listed ones; keys of one size and block differ by exclusive or."""
        return ((mix((keys >> _WIDTH).astype(np.uint64)) >> np.uint64(40)).astype(np.int64)) ^ (keys & ((1 << _WIDTH) - 1))

    def listed(self) -> np.ndarray:
        """A table that tells most keys that aren't in the index, made where it is used."""
        if not hasattr(self, "_listed"):
            self._listed = np.zeros(1 << 24, bool)
            self._listed[self._spots(self.key)] = True
        return self._listed

    @staticmethod
    def keys(prints: np.ndarray, size: np.ndarray | int, block: int) -> np.ndarray:
        value = (prints >> np.uint64(block * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)
        return ((np.asarray(size, np.int64) * BLOCKS + block) << _WIDTH) | value.astype(np.int64)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, items having ``size`` words."""
        found, asked = [], masks(RADIUS // BLOCKS - LISTED)
        for b in range(BLOCKS):
            k = self.keys(prints, size, b)
            spot = int(self._spots(self.keys(np.zeros(1, np.uint64), size, b))[0])
            window, change = np.nonzero(self.listed()[(k & ((1 << _WIDTH) - 1) ^ spot)[:, None] ^ asked[None, :]])
            k = k[window] ^ asked[change]
            lo, hi = np.searchsorted(self.key, k, "left"), np.searchsorted(self.key, k, "right")
            n = hi - lo
            if n.any():
                window = np.repeat(window, n)
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                item = self.item[at]
                near = np.bitwise_count(prints[window] ^ self.print[item]) <= RADIUS
                found.append(np.stack([window[near], item[near]], axis=1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def hits(self, h: np.ndarray, end_of: np.ndarray) -> np.ndarray:
        """Words at which some item's shingle begins; ``end_of``: end of the document of each word."""
        out = np.zeros(len(h), bool)
        for k, (known, table, *_) in self.gate.items():
            x = shingles(h, k) if k == K else shingle_sequence(h, k)  # whole short items are hashed as sequences
            at = np.flatnonzero(table[(x >> np.uint64(44)).astype(np.int64)])
            at = at[known[np.minimum(np.searchsorted(known, x[at]), len(known) - 1)] == x[at]]
            out[at[at + k <= end_of[at]]] = True
        return out

    def lengths(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Lengths of the items that have a shingle at these places: no other item can be found around them."""
        out = [np.zeros(0, np.int64)]
        for k, (known, _, first, sizes) in self.gate.items():
            x = np.unique((shingles(h, k) if k == K else shingle_sequence(h, k))[at[at <= len(h) - k]])
            i = np.minimum(np.searchsorted(known, x), len(known) - 1)
            out += [sizes[first[j] : first[j + 1]] for j in i[known[i] == x].tolist()]
        return np.unique(np.concatenate(out))

    def search(self, h: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, float]]:
        """(first word, item number, similarity): the best window of each item in one document."""
        best: dict[int, tuple[float, int]] = {}
        seen = np.concatenate([[0], np.cumsum(hit)])
        for a, b in regions(np.flatnonzero(hit), int(self.sizes[-1]), len(h)):
            lengths = self.lengths(h[a:b], np.flatnonzero(hit[a:b])).tolist()
            if not lengths:
                continue
            sums = bit_sums(h[a:b])
            for size in lengths:
                if size > b - a:
                    break
                starts = np.arange(a, b - size + 1)
                starts = starts[seen[starts + max(1, size - K + 1)] > seen[starts]]
                if not len(starts):
                    continue
                prints = fingerprints(sums, size)[starts - a]
                for window, item in zip(*self.candidates(prints, size), strict=True):
                    s = int(starts[window])
                    value = similarity(_counts(h[s : s + size]), self.counts[item])
                    if value >= THRESHOLD and (item not in best or (value, -s) > (best[item][0], -best[item][1])):
                        best[int(item)] = (value, s)
        return [(s, item, value) for item, (value, s) in sorted(best.items())]

    def find(self, texts: pa.Array):
        """(row, first word, item number, similarity) over an array of texts."""
        if not self.ids:
            return
        texts = plain(texts)
        for i, j in slices(texts):
            w = words(texts[i:j], PUNCTUATION)
            h = w.hashes()
            n = np.diff(w.first)
            hit = self.hits(h, np.repeat(w.first[1:], n))
            of = np.unique(np.searchsorted(w.first, np.flatnonzero(hit), "right") - 1)
            for d in of:
                a, b = w.first[d], w.first[d + 1]
                for s, item, value in self.search(h[a:b], hit[a:b]):
                    yield i + int(d), s, item, value


def regions(hits: np.ndarray, reach: int, n: int):
    """Ranges of words around hits, cut to a bounded length with an overlap that no window exceeds."""
    if not len(hits):
        return
    cut = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
    for group in np.split(hits, cut):
        a, b = max(0, int(group[0]) - reach), min(n, int(group[-1]) + reach + K)
        while b - a > _REGION + reach:
            yield a, a + _REGION + reach
            a += _REGION
        yield a, b


def _indexes(items: DataFrame, item_text: str, item_key: str) -> tuple[int, Iterator[Index]]:
    """Number of passes, and their indexes, made one by one."""
    rows = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    passes = max(1, -(-rows.count() // ITEMS_A_PASS))
    if passes == 1:
        return 1, iter([Index([tuple(r) for r in rows.orderBy("i", "t").collect()])])
    # twice as many, for what chance puts above the bound in a block
    blocks = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(2 * passes)))
    return 2 * passes, (Index([(r.i, r.t) for r in blocks.where(F.col("b") == b).orderBy("i", "t").collect()]) for b in range(2 * passes))


def _searched(source: DataFrame, index: Index, key: str, item_key: str) -> DataFrame:
    """Matches of (key, text) rows with the items of one index."""
    shipped = source.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        cache("decontaminate")
        index = shipped.value
        for batch in batches:
            found = list(index.find(batch.column(1)))
            rows, first, item, value = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([index.ids[x] for x in item], pa.int64()), pa.array(first, pa.int64()), pa.array([int(index.size[x]) for x in item], pa.int64()), pa.array(value, pa.float64())], names=[key, item_key, "first_word", "n_words", "similarity"])

    return source.mapInArrow(trimmed(run), f"`{key}` long, `{item_key}` long, first_word long, n_words long, similarity double")


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row per document row and item found in it: key, item key, first_word, n_words, similarity (of the best window)."""
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    passes, indexes = _indexes(items, item_text, item_key)
    out = None
    for index in indexes:
        one = _searched(source, index, key, item_key)
        one = written(one, "matches") if passes > 1 else one
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. In one pass nothing is shuffled; after several,
    the texts found are left out by two 64-bit hashes."""
    at = docs.columns.index(text)
    passes, indexes = _indexes(items, item_text, item_key)
    if passes == 1:
        shipped = docs.sparkSession.sparkContext.broadcast(next(indexes))

        def run(batches):
            cache("decontaminate")
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in shipped.value.find(batch.column(at).cast(pa.large_string()))]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(trimmed(run), docs.schema)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    hashed = [F.xxhash64(t), F.xxhash64(t, F.lit(1))]
    source = docs.select(F.struct(*(x.alias(n) for x, n in zip(hashed, "ab", strict=True))).alias("h"), t.alias("t"))
    found = None
    for index in indexes:
        shipped = source.sparkSession.sparkContext.broadcast(index)

        def mark(batches, shipped=shipped):
            cache("decontaminate")
            for batch in batches:
                rows = sorted({row for row, *_ in shipped.value.find(batch.column(1))})
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64()))], names=["h"])

        one = written(source.mapInArrow(trimmed(mark), "h struct<a:bigint,b:bigint>"), "found")
        found = one if found is None else found.unionByName(one)
    found = written(found.select("h.a", "h.b").distinct(), "found")
    return docs.join(found, (hashed[0] == found["a"]) & (hashed[1] == found["b"]), "left_anti")
