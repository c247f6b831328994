"""Words and word shingles of whole Arrow batches, as numpy arrays.

Texts are taken as their UTF-8 bytes. A batch is handled in slices of a few MB, so memory follows the slice
(or the longest single text), never the batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the contracts: blank and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and all ASCII punctuation.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, 1 << 16)
        for k, base in (("p", P), ("q", P_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["q"][:n]


def plain(texts: pa.Array) -> pa.Array:
    """As one array of large strings without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    return pc.fill_null(texts, "") if texts.null_count else texts


def offsets_and_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of an array that :func:`plain` made: byte offsets from 0, and the bytes."""
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, o, d = texts.buffers()
    offs = np.frombuffer(o, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(d, np.uint8)[offs[0] : offs[-1]] if d is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return offs - offs[0], data


def slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, one row at least."""
    offs, _ = offsets_and_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """``data[offsets[w]:offsets[w + 1]]`` is word w; document d has words ``first[d]`` to ``first[d + 1]``;
    ``starts`` and ``ends`` are the words' byte places in the slice."""

    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def strings(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_string(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data))])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hashes(self.data, self.offsets)


def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte strings that stand one after the other."""
    p, q = _power(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=h[1:])
    a, b = offsets[:-1], offsets[1:]
    return mix((h[b] - h[a]) * q[a] + (b - a).astype(np.uint64))


#: Classes for a further cut: 1 ASCII letters, 2 ASCII punctuation but the apostrophe, 4 all else.
KINDS = np.full(256, 4, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = 1
KINDS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2


def words(texts: pa.Array, separators: np.ndarray = SPACE, fold: np.ndarray = LOWER, kinds: np.ndarray | None = None) -> Words:
    """The words of one slice: longest runs of bytes that are not separators. With ``kinds``, also cut between
    bytes of kinds 1 and 2."""
    offs, data = offsets_and_bytes(texts)
    n = len(data)
    data = fold[data]
    inside = ~separators[data]
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        start[cut] |= inside[cut]
        end[cut - 1] |= inside[cut - 1]
        if kinds is not None:
            k = kinds[data]
            turn = (k[1:] ^ k[:-1]) == 3
            start[1:] |= turn
            end[:-1] |= turn
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return Words(data[inside], offsets, np.searchsorted(starts, offs), starts, ends)


_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places of ``h`` have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _MULTIPLIERS[i % 64]
    return mix(out)


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct shingles of one document; with fewer words than k the whole sequence counts as one."""
    if len(h) >= k:
        return np.unique(shingles(h, k))
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix(np.array([np.sum(h * _MULTIPLIERS[: len(h)]) + np.uint64(len(h))], np.uint64))


def shingle_sequence(h: np.ndarray, k: int) -> np.ndarray:
    """For k words at each place: the hash that a document of these words alone has, where a set needs more words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _MULTIPLIERS[i]
    return mix(out)
