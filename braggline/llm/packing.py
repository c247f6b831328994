"""Concatenate and cut: documents' token ids form one long row that is cut into sequences of fixed length.

Two passes. The first tokenises every whole text once, keeps the ids (two bytes each where the vocabulary
allows) in a table of the shared folder and notes how many ids stand before each document in its partition.
Prefix sums over the partitions' totals (one row per partition) then give each document a global offset, and
the second pass cuts at multiples of the sequence length and writes one boundary record per piece.

Only the end of the whole row can need padding; it is cut into power-of-two sequences, which need none.

Very long texts are encoded in memory that follows the text and cut into as many pieces as they need. Null texts count
as empty: a document without text still has its end id. Repeated rows are packed as often as
they occur, null ids stay null, an empty table gives no pieces, and further columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .worker import cache, trimmed
from .words import KINDS, SAME, hashes, offsets_and_bytes, plain, slices, words

LENGTH, END_ID = 4096, 2
#: Texts are cut at blank, tab, line feed and carriage return, and between ASCII letters and ASCII punctuation, where the
#: pre-tokeniser cuts as well; anything else it sees itself.
_CUT = np.zeros(256, bool)
_CUT[[9, 10, 13, 32]] = True
#: Words that a worker remembers; beyond, it starts afresh.
REMEMBERED = 1_500_000
#: Words encoded at once: what the library returns of each takes many times its ids.
AT_ONCE = 1 << 13


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space, each distinct word being encoded once. Known words
    are told apart by 64-bit hashes; each then takes some 25 bytes.

    Exact for tokenizers whose pieces never span white space, as with ``word_bpe_49k.json``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        # sorted hashes of the known words and their numbers; ids of word n are flat[begin[n]:begin[n] + length[n]]
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.begin, self.length = np.zeros(1 << 20, self.dtype), np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        self.used = 0

    def _learn(self, h: np.ndarray, new: list[str]) -> None:
        gc.disable()  # many short-lived objects, none of them in cycles
        sizes, flats = [], []
        for i in range(0, len(new), AT_ONCE):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(new[i : i + AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flats.append(np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes[-1].sum())))
        gc.enable()
        size = np.concatenate(sizes)
        n, more = len(self.known), int(size.sum())
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.begin[n : n + len(new)] = self.used + np.cumsum(size) - size
        self.length[n : n + len(new)] = size
        self.flat[self.used : self.used + more] = np.concatenate(flats)
        self.used += more
        order = np.argsort(h)
        at = np.searchsorted(self.known, h[order])
        self.known, self.number = np.insert(self.known, at, h[order]), np.insert(self.number, at, (n + order).astype(np.int32))

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of distinct words, after learning those that aren't known yet."""
        offs, data = offsets_and_bytes(distinct)
        h = hashes(data, offs)
        missing = self._missing(h)
        if missing.any():
            if len(self.known) + int(missing.sum()) > REMEMBERED:
                self._reset()
                missing[:] = True
            self._learn(h[missing], distinct.filter(pa.array(missing)).to_pylist())
        return self.number[np.searchsorted(self.known, h)]

    def _missing(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(h), bool)
        return self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] != h

    def encode(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """Ids of each text, slice by slice. Texts with special strings are encoded as they are."""
        texts = plain(texts)
        slow = pc.match_substring_regex(texts, "|".join(map(re.escape, self.special)) or "$^").to_numpy(zero_copy_only=False)
        for i, j in slices(texts, 2 << 20):
            w = words(texts[i:j], _CUT, SAME, KINDS)
            coded = w.strings().dictionary_encode()
            at = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            size = self.length[at].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(self.begin[at] - ends[:-1], size) + np.arange(ends[-1])]
            bounds = ends[w.first]
            out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for d in np.flatnonzero(slow[i:j]):
                out[d] = np.array(self.tokenizer.encode(texts[int(i + d)].as_py(), add_special_tokens=False).ids, self.dtype)
            yield out


def word_tokens(path: str) -> WordTokens:
    held = cache("packing")
    if path not in held:
        held[path] = WordTokens(path)
    return held[path]


def tokenised(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """(key, part, before, n_tokens, ids): ids as little-endian bytes, ``before`` the ids that precede it in its partition."""

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        model = word_tokens(tokenizer)
        for batch in batches:
            keys, at = batch.column(0), 0
            for group in model.encode(batch.column(1)):
                rows = [np.append(x, model.dtype(end_id)) for x in group]
                size = np.fromiter(map(len, rows), np.int64, len(rows))
                ends = before + np.cumsum(size)
                yield pa.RecordBatch.from_arrays([keys[at : at + len(rows)], pa.array(np.full(len(rows), part, np.int32)), pa.array(ends - size), pa.array(size), pa.array([x.tobytes() for x in rows], pa.binary())], names=[key, "part", "before", "n_tokens", "ids"])
                at, before = at + len(rows), int(ends[-1])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(trimmed(run), f"`{key}` long, part int, before long, n_tokens long, ids binary")


def bounds_of(total: int, length: int) -> np.ndarray:
    """Ends of the sequences after the last full one: the rest as powers of two, largest first."""
    full, rest = divmod(total, length)
    ends, at = [], full * length
    for bit in range(length.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return np.array(ends, np.int64)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    table = written(tokenised(docs, tokenizer, text, key, end_id), "tokens")
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per partition of the input, whatever its rows; 8 bytes for each go to the executors
    sums = totals.select("part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset")).toPandas()
    offsets = np.zeros(int(sums["part"].max()) + 1 if len(sums) else 0, np.int64)
    offsets[sums["part"].to_numpy(np.int64)] = sums["offset"].to_numpy(np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast(offsets)
    total = int(sums["n"].sum()) if len(sums) else 0
    full, last = total // length, bounds_of(total, length)
    wide = word_tokens(tokenizer).dtype is np.uint32

    def cut(batches):
        offset_of = shipped.value
        for batch in batches:
            keys, parts, before, n_tokens, blobs = (batch.column(i) for i in range(5))
            out: list[list] = [[] for _ in range(7)]
            for k, p, b, n, blob in zip(keys.to_pylist(), parts.to_pylist(), before.to_pylist(), n_tokens.to_pylist(), blobs, strict=True):
                ids = np.frombuffer(blob.as_buffer(), np.uint32 if wide else np.uint16).astype("<u4")
                place, start = int(offset_of[p]) + b, 0
                while start < n:
                    if (sequence := place // length) < full:
                        first, end = sequence * length, (sequence + 1) * length
                    else:
                        i = int(np.searchsorted(last, place, "right"))
                        sequence, first, end = full + i, int(last[i - 1]) if i else full * length, int(last[i])
                    size = min(n - start, end - place)
                    for column, value in zip(out, (k, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, place - first), strict=True):
                        column.append(value)
                    start, place = start + size, place + size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return table.mapInArrow(trimmed(cut), f"`{key}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
