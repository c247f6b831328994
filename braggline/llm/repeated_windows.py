"""Repeated windows: bytes inside any string of ``WINDOW`` bytes that starts at two places of the corpus.

All windows are put in order by a radix sort, most significant digit first, that goes no deeper than the window: a pass looks
at one digit of a window, windows alone with theirs leave the sort, and those that are equal through all digits are
exactly the repeated ones. As neighbouring windows overlap, digits are chosen so that many have one in common and
need one row:

* The first digit is the least hash among a window's strings of ``GRAM`` bytes (the leftmost of equals), which
  depends on the window alone. Windows in a row that share it, some seventy, are one row.
* The next pass takes each such row in blocks of ``BLOCK`` windows, counted from the place of the first digit; the
  digit is the string that all windows of a block have in common, 185 bytes.
* The last pass takes each window by itself, all of its bytes.

A row also holds a fingerprint of all the bytes that its windows cover. Where that is found twice, all windows of the row are
repeated; so copies and long passages are found in the first pass, and go on as one row, if others have the same digit at all.
What goes on are mostly the windows around the ends of passages. Digits are counted map-side first and rows are looked up by joins whose hot sides can
be split; a digit's rows are never gathered. Neighbouring rows with equal fingerprints (one string over and over)
become one row of several, repeated in itself.

Texts are taken as UTF-8; windows never cross documents, but may repeat within one, overlapping or not. Fingerprints have
64 bits beside the digit's 64; single windows 128. A null text is empty; texts shorter than a window lose nothing; rows
with equal id and text are each other's copies and get equal results; a null id is a document like others; an
empty table gives no rows; further columns are ignored. Very long texts are cut into overlapping parts, so memory
follows the part, and the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, written
from .words import _power, mix, offsets_and_bytes, plain

WINDOW = 200
#: Bytes of the strings whose least hash is the first digit.
GRAM = 64
#: Windows of a block of the second pass.
BLOCK = 16
#: Bytes handled at once.
PART = 1 << 20
#: Multiplier of the second fingerprint of single windows.
_OTHER = np.uint64(0xD6E8FEB86659FD93)

_ROW = "core long, whole long, id long, th long, start int, wins int, lead int"


def _parts(offs: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that together hold every window of every text; ranges cut a text only if it alone is longer."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        a, b = int(offs[i]), int(offs[j])
        while b - a > 2 * size + overlap:  # one long text
            yield a, a + size + overlap
            a += size
        yield a, b
        i = j


def _prefix(data: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
    p, _ = _power(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64) + np.uint64(1) if salt is None else salt[data]
    np.cumsum(values * p[: len(data)], out=h[1:])
    return h


def _hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the bytes from ``a`` up to ``b``."""
    _, q = _power(len(h))
    return mix((h[b] - h[a]) * q[a] + (b - a).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values)
    x = np.full((-(-n // width) + 1) * width, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = values
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _first_rows(data: np.ndarray, offs: np.ndarray, a: int, b: int, window: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """(text, start, windows, lead, core, whole) of rows of windows that share their first digit, in bytes ``a`` to ``b``."""
    if b - a < window:
        return None
    part = data[a:b]
    h = _prefix(part)
    at = np.arange(len(part) - gram + 1)
    g = _hash(h, at, at + gram)
    least = _least((g & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), window - gram + 1) & np.uint64(0xFFFFFFFF)
    begin = np.arange(len(part) - window + 1)
    text = np.searchsorted(offs, begin + a, "right") - 1
    inside = np.flatnonzero(begin + a + window <= offs[text + 1])
    if not len(inside):
        return None
    least, text = least[inside].astype(np.int64), text[inside]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
    start, wins, anchor, text = inside[first], np.diff(np.append(first, len(inside))), least[first], text[first]
    whole, core = _hash(h, start, start + wins - 1 + window), g[anchor]
    # one string over and over: of neighbours with equal fingerprints the first is a row, the rest another, its windows negative
    like = np.append(False, (text[1:] == text[:-1]) & (core[1:] == core[:-1]) & (whole[1:] == whole[:-1]) & (start[1:] == start[:-1] + wins[:-1]))
    keep = np.flatnonzero(~(like & np.append(False, like[:-1])))
    last = np.append(keep[1:], len(start)) - 1
    wins = np.where(like[keep], -(start[last] + wins[last] - start[keep]), wins[keep])
    start, text = start[keep], text[keep]
    return text, start + a - offs[text], wins, anchor[keep] - start, core[keep], whole[keep]


def _later_rows(data: np.ndarray, text: np.ndarray, offs: np.ndarray, start: np.ndarray, wins: np.ndarray, lead: np.ndarray, block: int, window: int) -> tuple[np.ndarray, ...]:
    """The same of undecided rows, cut into blocks of windows that begin equally far from the first digit."""
    begin = offs[text] + start
    # a window's distance before the first digit, from lead down to lead - wins + 1
    high, low = lead // block, (lead - wins + 1) // block
    n = high - low + 1
    row = np.repeat(np.arange(len(start)), n)
    b = high[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    far, near = np.minimum(lead[row], b * block + block - 1), np.maximum(lead[row] - wins[row] + 1, b * block)
    own, count = start[row] + lead[row] - far, far - near + 1
    zero = begin[row] + lead[row]
    h = _prefix(data)
    s = begin[row] + lead[row] - far
    if block == 1:
        salt = mix(np.arange(1, 257, dtype=np.uint64) * _OTHER)
        return text[row], own, count, far, _hash(h, s, s + window), _hash(_prefix(data, salt), s, s + window)
    # what all windows of a full block have in common, whether or not this row has all of them
    core = _hash(h, zero - b * block, zero - (b * block + block - 1) + window)
    return text[row], own, count, far, core, _hash(h, s, s + count - 1 + window)


def _batch(rows: tuple[np.ndarray, ...], ids: np.ndarray, th: np.ndarray) -> pa.RecordBatch:
    text, start, wins, lead, core, whole = rows
    columns = [core.view(np.int64), whole.view(np.int64), ids[text], th[text], start.astype(np.int32), wins.astype(np.int32), lead.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["core", "whole", "id", "th", "start", "wins", "lead"])


def _hashed(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _documents(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), _hashed(text).alias("th"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())


def first_pass(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), plain(batch.column(2))
            offs, data = offsets_and_bytes(texts)
            for a, b in _parts(offs, PART, window - 1):
                rows = _first_rows(data, offs, a, b, window, gram)
                if rows is not None:
                    yield _batch(rows, ids, th)

    return _documents(docs, text, key).mapInArrow(run, _ROW)


def _per_text(rows: DataFrame) -> DataFrame:
    """(id2, th2, rows): a text's own rows, of which it has no more than windows."""
    return rows.groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_list(F.struct("start", "wins", "lead")).alias("rows"))


def later_pass(docs: DataFrame, undecided: DataFrame, block: int, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), plain(batch.column(2))
            offs, data = offsets_and_bytes(texts)
            lists = batch.column(3)
            of, fields = pc.list_parent_indices(lists).to_numpy().astype(np.int64), lists.flatten()
            start, wins, lead = (fields.field(c).to_numpy().astype(np.int64) for c in range(3))
            order = np.lexsort((start, of))
            of, start, wins, lead = of[order], start[order], wins[order], lead[order]
            # lots of rows whose bytes are close together; the bytes between are hashed along
            begin, end = offs[of] + start, offs[of] + start + wins - 1 + window
            lot = begin // PART
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(lot)) + 1):
                if len(part):
                    a, b = int(begin[part].min()), int(end[part].max())
                    yield _batch(_later_rows(data[a:b], of[part], offs - a, start[part], wins[part], lead[part], block, window), ids, th)

    lists = written(_per_text(undecided), "undecided")
    rows = _documents(docs, text, key)
    # rows with equal id and text read the same list; each is a text of its own
    both = rows.join(lists, (F.col("id") == F.col("id2")) & (F.col("th") == F.col("th2"))).select("id", "th", "t", "rows")
    return both.mapInArrow(run, _ROW)


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of written rows: the windows (id, th, start, wins) of those whose bytes another row has too, and the rows of the next pass. These are the rows
    whose digit, but not all bytes, others have; rows of equal bytes are one there, as a witness for others. Both are written tables."""
    weight = F.when(F.col("wins") < 0, 2).otherwise(1)
    cores = written(rows.groupBy("core").agg(F.sum(weight).alias("n")).where("n > 1").select(F.col("core").alias("c")), "cores")
    some = written(rows.join(cores, rows["core"] == cores["c"]).drop("c"), "digit")
    drop(cores)
    # any of a group's rows stands for it, but for one string over and over
    one = [F.first(F.when(F.col("wins") > 0, F.col(c)), ignorenulls=True).alias(c) for c in ("id", "th", "start", "wins", "lead")]
    groups = written(some.groupBy(F.col("core").alias("c"), F.col("whole").alias("w")).agg(F.sum(weight).alias("n"), *one), "groups")
    twice = groups.where("n > 1").select("c", "w")
    known = some.join(twice, (some["core"] == twice["c"]) & (some["whole"] == twice["w"])).select("id", "th", "start", F.abs("wins").alias("wins"))
    known = written(known, "known")
    drop(some)
    mixed = groups.groupBy(F.col("c").alias("open")).agg(F.min("n").alias("least"), F.count("*").alias("groups")).where("least = 1 and groups > 1").select("open")
    mixed = written(mixed, "mixed")
    further = written(groups.join(mixed, groups["c"] == mixed["open"]).select("id", "th", "start", "wins", "lead"), "further")
    drop(groups, mixed)
    return known, further


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(id, th, start, wins), a written table: windows of a text (by its id, 0 for null, and hash) that occur elsewhere, a stretch a row."""
    rows, parts = written(first_pass(docs, text, key, window, gram), "digits"), []
    for size in (block, 1, 0):
        known, further = settled(rows)
        drop(rows)
        parts.append(known)
        if not size or further.isEmpty():
            drop(further)
            break
        rows = written(later_pass(docs, further, size, text, key, window), "digits")
        drop(further)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = written(out, "repeats")
    drop(*parts)
    return out


def cut(text: bytes, start: np.ndarray, wins: np.ndarray, window: int) -> tuple[list[tuple[int, int]], bytes]:
    """(spans to remove, what is left) for stretches of repeated windows."""
    if not len(start):
        return [], text
    order = np.argsort(start)
    s, e = start[order], np.maximum.accumulate((start + wins - 1 + window)[order])
    first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    spans = list(zip(s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist(), strict=True))
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return spans, b"".join([*kept, text[at:]])


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: key, ``n_bytes``, ``spans`` (removed byte ranges, ends exclusive) and ``kept``, the bytes that are left. A cut may part
    a letter of several bytes, so that ``kept`` is binary."""
    found = repeats(docs, text, key, window, gram, block)
    lists = written(found.groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_set(F.struct("start", "wins")).alias("rows")), "lists")
    drop(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                spans, kept, size = [], [], []
                rows = part.column(2)
                for k, t in enumerate(plain(part.column(1)).cast(pa.large_binary()).to_pylist()):
                    r = rows[k].values
                    starts, wins = (np.zeros(0, np.int64),) * 2 if r is None else (r.field(c).to_numpy().astype(np.int64) for c in range(2))
                    x, left = cut(t, starts, wins, window)
                    spans.append([{"start": a, "end": b} for a, b in x])
                    kept.append(left)
                    size.append(len(t))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    own = docs.select(F.col(key).cast("long").alias("own"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), _hashed(text).alias("th"), F.col(text).cast("string").alias("t"))
    both = own.join(lists, (F.col("id") == F.col("id2")) & (F.col("th") == F.col("th2")), "left").select("own", "t", "rows")
    return both.mapInArrow(run, f"`{key}` long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(cut_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of :func:`without_repeats`."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return cut_docs.select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
