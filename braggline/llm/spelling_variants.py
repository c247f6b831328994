"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words are counted over all texts, pre-aggregated in batches and map-side. Each word then stands in a forward and a
reversed sorted dictionary: one edit leaves a half of a word intact, so two words one edit apart share the first half
(a block of the forward dictionary) or the last half (a block of the reversed one). Blocks are ranges of the sorted
dictionary and are scanned there. A block of more than ``BLOCK`` words isn't scanned but subdivided: what the shared
half leaves of its words is one edit apart too, and so has a half intact again, down to words that differ in one
place, of which there are no more than letters. A pair is taken from the block of the first half wherever it shares
that, so that each is found once. Found pairs are verified letter by letter, never written out beyond a row for each word of a
block (count of partners, best partner), and summed up.

Equal lengths (one letter replaced) and neighbouring lengths (one inserted or deleted) have blocks of their own.
Words are runs of A-Z, a-z and U+00C0 to U+00FF, so that a letter is a byte of Latin-1. A null text has no words; a
null id counts as an empty one; repeated rows are counted each; an empty table gives no rows; further columns are
ignored. Very long texts are handled in memory that follows the longest; very long words are words like others. Ties
between partners fall to the least in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, written
from .words import LOWER, offsets_and_bytes, plain, slices

#: Least letters and occurrences of a word; a form has so many times a variant's occurrences.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: One occurrence in so many loses a letter.
NOISE = 31
#: Words of a block that is scanned; more than there are letters, so that subdividing comes to an end.
BLOCK = 128
#: Runs counted at once, and pairs compared at once (bytes).
RUNS, PAIRS = 1 << 21, 1 << 23
#: Beyond all lengths.
FAR = 1 << 30

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_zeros: dict[str, np.ndarray] = {}


def _shift_table(longest: int) -> np.ndarray:
    """[length, byte, value]: what a CRC-32 becomes, byte by byte, when ``length`` further bytes follow."""
    held = _zeros.get("t")
    if held is None or len(held) <= longest:
        step = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)
        x = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
        rows = [x]
        for _ in range(max(longest, 63)):
            x = (x >> np.uint32(8)) ^ step[x & np.uint32(255)]
            rows.append(x)
        _zeros["t"] = held = np.stack(rows)
    return held


def joined_crc32(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings one after the other, from those of each and the second one's length (up to 255)."""
    t = _shift_table(int(length.max(initial=0)))
    out = second.copy()
    for b in range(4):
        out ^= t[length, b, (first >> np.uint32(8 * b)) & np.uint32(255)]
    return out


def counted(ids: list[str], texts: pa.Array, letters: int = LETTERS, noise: int = NOISE) -> tuple[list[str], list[int]]:
    """Words of these texts and how often they occur, some occurrences less a letter."""
    offs, data = offsets_and_bytes(texts)
    data = LOWER[data]
    lead, follows = data == 0xC3, (data & 0xC0) == 0x80
    inside = _LETTER[data] | lead
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1] & follows[1:]
    inside |= second
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        start[cut] |= inside[cut]
        end[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    twos = np.concatenate([[0], np.cumsum(second)])
    n_letters = ends - starts - (twos[ends] - twos[starts])
    keep = n_letters >= letters
    if not keep.any():
        return [], []
    starts, ends, n_letters = starts[keep], ends[keep], n_letters[keep]
    owner = np.searchsorted(offs, starts, "right") - 1
    size = ends - starts
    # the kept runs' bytes, one after the other
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    packed = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    runs = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))]).dictionary_encode()
    code, names = runs.indices.to_numpy(), runs.dictionary.to_pylist()
    of_word = np.array([zlib.crc32(w.encode()) for w in names], np.uint32)
    of_id = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    short = size < 256
    h = np.zeros(len(size), np.uint32)
    h[short] = joined_crc32(of_id[owner[short]], of_word[code[short]], size[short])
    for k in np.flatnonzero(~short).tolist():
        h[k] = zlib.crc32(names[code[k]].encode(), int(of_id[owner[k]]))
    hit = h % noise == 0
    times = np.bincount(code[~hit], minlength=len(names))
    less = Counter()
    at = (h % n_letters.astype(np.uint32))[hit].tolist()
    for w, p in zip(code[hit].tolist(), at, strict=True):
        less[names[w][:p] + names[w][p + 1 :]] += 1
    for w in [w for w in less if len(w) < letters]:
        del less[w]
    some = np.flatnonzero(times)
    return [names[k] for k in some.tolist()] + list(less), times[some].tolist() + list(less.values())


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", letters: int = LETTERS, least: int = OCCURRENCES, noise: int = NOISE) -> DataFrame:
    """(word, n) of words of at least ``letters`` letters that occur at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), plain(batch.column(1))
            for i, j in slices(texts, 1 << 22):
                for w, n in zip(*counted(ids[i:j], texts.slice(i, j - i), letters, noise), strict=True):
                    held[w] += n
                if len(held) > RUNS // 8:
                    yield out()
        if held:
            yield out()

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- blocks ------------------------------------------------------------------------------------------------------------

#: Roles of a word in a block: one of equal length, the shorter and the longer one.
EQUAL, SHORTER, LONGER = 0, 1, 2


def roots(words: DataFrame) -> DataFrame:
    """Each word in its three roles, before any halving: ``m`` is the shorter word's length, ``left`` the letters that aren't shared
    yet, ``i`` and ``j`` the shared first and last letters, ``bound`` what a pair's common beginning must stay under."""
    size = F.length("word")
    role = lambda r, m: F.struct(F.lit(r).alias("role"), m.alias("m"))
    rows = words.select("word", "n", F.explode(F.array(role(EQUAL, size), role(SHORTER, size), role(LONGER, size - 1))).alias("x"))
    return rows.select("word", "n", "x.role", "x.m", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(FAR).alias("bound"), F.lit("").alias("path"))


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first and with the last half of the letters left as shared. A pair with all of that first half
    in common belongs to the first alone, which is what ``bound`` says of the second."""
    left = F.col("m") - F.col("i") - F.col("j")
    k = F.when(F.col("role") == EQUAL, F.floor(left / 2)).otherwise(F.floor((left + 1) / 2)).cast("int")
    first = F.struct((F.col("i") + k).alias("i"), F.col("j").alias("j"), F.col("bound").alias("bound"), F.concat("path", F.lit("<")).alias("path"))
    last = F.struct(F.col("i").alias("i"), (F.col("j") + k).alias("j"), F.least("bound", F.col("i") + k).alias("bound"), F.concat("path", F.lit(">")).alias("path"))
    rows = rows.select("word", "n", "role", "m", F.explode(F.array(first, last)).alias("x")).select("word", "n", "role", "m", "x.*")
    # the forward dictionary is in the order of beginnings, the reversed one in that of words read backwards
    ahead, back = F.substring("word", F.lit(1), F.col("i")), F.reverse(F.substring(F.reverse("word"), F.lit(1), F.col("j")))
    head = F.concat_ws(" ", F.when(F.col("path").startswith("<"), F.lit("<")).otherwise(F.lit(">")), F.when(F.col("path").startswith("<"), ahead).otherwise(F.reverse(back)))
    kind = F.when(F.col("role") == EQUAL, F.lit("=")).otherwise(F.lit("+"))
    return rows.withColumn("block", F.concat_ws(" ", head, kind, F.col("m").cast("string"), "path", ahead, back))


def _blocks(rows: DataFrame) -> DataFrame:
    """(block, large) of the blocks in which a pair is possible; counts are made map-side first."""
    found = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("role").alias("r"), F.max("role").alias("s"))
    return found.where((F.col("n") > 1) & ((F.col("s") == EQUAL) | (F.col("r") < F.col("s")))).select(F.col("block").alias("b"), (F.col("n") > BLOCK).alias("large"))


def _lead(equal: np.ndarray) -> np.ndarray:
    """How many columns from the first on are true."""
    return np.logical_and.accumulate(equal, axis=1).sum(axis=1)


def _one_edit(x: np.ndarray, y: np.ndarray, equal_lengths: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of letters: are ``x`` and ``y`` one edit apart, and how many letters from the first on are common.
    Of unequal lengths ``x`` is the shorter, and its last column isn't compared but for what is common from the first on: a pair may
    share a first half that ends just beyond."""
    if equal_lengths:
        differ = x != y
        return differ.sum(axis=1) == 1, differ.argmax(axis=1)
    ahead = _lead(x == y)
    return ahead + _lead((x[:, :-1] == y[:, 1:])[:, ::-1]) >= x.shape[1] - 1, ahead


def near_in_blocks(words: list[bytes], block_ends: np.ndarray, role: np.ndarray, left: np.ndarray, i: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block that are one edit apart and belong to it. Rows are in the order of block and role;
    ``block_ends`` holds where a row's block ends. Letters between the shared ones are compared, in lots of bounded size."""
    at = np.arange(len(words))
    longer = role == LONGER
    first_longer = np.searchsorted(np.cumsum(longer), np.concatenate([[0], np.cumsum(longer)])[at] + 1)
    from_ = np.where(role == EQUAL, at + 1, np.where(longer, block_ends, first_longer))
    pairs = np.maximum(block_ends - from_, 0)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for kind in (True, False):
        for width in np.unique(left[((role == EQUAL) == kind) & (pairs > 0)]).tolist():
            rows = np.flatnonzero(((role == EQUAL) == kind) & (left == width))
            cut = [words[r][i[r] : i[r] + width + (not kind)].ljust(width + (not kind), b"\0") for r in rows.tolist()]
            letters = np.frombuffer(b"".join(cut), np.uint8).reshape(len(rows), -1)
            place = np.zeros(len(words), np.int64)
            place[rows] = np.arange(len(rows))
            lot = np.cumsum(pairs[rows]) * (width + 1) // PAIRS
            for part in np.split(rows, np.flatnonzero(np.diff(lot)) + 1):
                n = pairs[part]
                a = np.repeat(part, n)
                b = np.repeat(from_[part] - (np.cumsum(n) - n), n) + np.arange(len(a))
                ok, ahead = _one_edit(letters[place[a]], letters[place[b]], kind)
                ok &= i[a] + ahead < bound[a]
                out.append((a[ok], b[ok]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _best(n: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of pairs: its place, its partners, and the partner of largest n (ties: of least rank)."""
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return a[first], np.diff(np.append(first, len(a))), b[first]


def scanned(rows: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) a row for each word of a block with partners there, from a range scan of the
    sorted dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            block = t.column("block")
            last = pc.index(block, block[len(block) - 1]).as_py()  # rows are in order: from here on all are of the last block
            if last:
                yield found(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None:
            yield found(rest)

    def found(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        block = t.column("block").combine_chunks()
        change = pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [len(block)]])
        word = t.column("word").combine_chunks()
        n, role, m, i, j, bound = (t.column(c).to_numpy() for c in ("n", "role", "m", "i", "j", "bound"))
        a, b = near_in_blocks([w.encode("latin-1") for w in word.to_pylist()], np.repeat(bounds[1:], np.diff(bounds)), role, m - i - j, i, bound)
        rank = np.empty(len(word), np.int64)
        rank[pc.sort_indices(word).to_numpy()] = np.arange(len(word))
        at, partners, best = _best(n, rank, a, b)
        return pa.RecordBatch.from_arrays([word.take(pa.array(at)), pa.array(partners, pa.int64()), pa.array(n[best], pa.int64()), word.take(pa.array(best))], names=["word", "n_near", "best_n", "best"])

    dictionary = rows.select("block", "word", "n", "role", "m", "i", "j", "bound").repartitionByRange(F.col("block")).sortWithinPartitions("block", "role", "word")
    return dictionary.mapInArrow(run, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best), a written table: how many words are one edit apart from a word of the written table
    ``words`` (word, n), and the most frequent of them; words without any have no row."""
    rows, source, parts = halved(roots(words)), None, []
    while True:
        rows = written(rows, "halved")
        if source is not None:
            drop(source)
        blocks = written(_blocks(rows), "blocks")
        source = written(rows.join(blocks, rows["block"] == blocks["b"]).drop("b"), "shared")
        drop(rows, blocks)
        parts.append(written(scanned(source.where("not large")), "near"))
        large = source.where("large").drop("large", "block")
        if large.isEmpty():
            drop(source)
            break
        rows = halved(large)
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    out = written(near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best")), "near_words")
    drop(*parts)
    return out


def followed(forms: DataFrame) -> DataFrame:
    """(word, root), a written table, of (word, form) rows: where the forms lead to. A form occurs many times as often as its word, so
    that there are no cycles and few steps; each step doubles the way."""
    way = written(forms.select("word", F.col("form").alias("root")), "way")
    while True:
        on = way.select(F.col("word").alias("w"), F.col("root").alias("further"))
        far = written(way.join(on, way["root"] == on["w"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "way")
        drop(way)
        way = far
        if way.where("moved").isEmpty():
            return way.drop("moved")


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", letters: int = LETTERS, least: int = OCCURRENCES, times: int = TIMES, noise: int = NOISE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its form is the most frequent word one edit apart, if that occurs at least ``times``
    as often; its root is where forms lead to, itself if it has none."""
    words = written(word_counts(docs, text, key, letters, least, noise), "words")
    near = near_words(words)
    known = words.join(near.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").drop("w")
    has: Column = F.col("best_n") >= times * F.col("n")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    drop(words, near)
    root = followed(known.where("form is not null"))
    out = known.join(root.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
