"""Collocations: phrases that occur oftener than their parts explain, by sorting truncated suffixes.

Every word begins a suffix of at most ``longest`` words of its piece. Suffixes are counted in batches first, dealt to tasks
by language and first word, and sorted there in reverse lexicographic order, so that a phrase stands after all its
extensions; one pass with a stack of the open prefixes then counts all phrases. A first word with more than one in
``HOT`` of all words would fill a task: the words of such a suffix are taken into its share one by one, up to the first
that isn't that frequent. Counts of phrases of frequent words alone are then parts, and summed up. Which words are
frequent comes from a count of all words, which also gives the counts of single words.

Counts of a phrase's parts are joined afterwards: each cut of a phrase into two gives a ratio of its count to that of its
parts, and the lowest counts. A phrase mostly found inside a longer one is dropped. All arithmetic is exact (decimals of
38 digits: counts up to ten to the 16th).

A null text is empty, a null language is ``und``; repeated rows are counted each; an empty table gives no rows; further
columns are ignored. Very long texts are handled in memory that follows the longest. Only A-Z is folded. Equal scores
and counts are ranked by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, written
from .words import P, hashes, mix, offsets_and_bytes, plain, slices, words
from .worker import trim

#: Words of a phrase, its least count, and the share (in hundredths) of a phrase's count that drops it if a longer one has it.
LONGEST, LEAST, ABSORBED, TOP = 3, 10, 50, 2000
#: Bytes that end a piece, and those that part words within it.
BREAKS, BLANKS = (*b".,;:!?", *range(0x0A, 0x0E)), (0x09, 0x20)
#: A word is frequent if it is at least one in so many of all words.
HOT = 1000
#: Bytes of text whose suffixes are counted together.
SLICE = 6 << 20

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[list(BLANKS)] = True


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("t"))


def _tokens(langs: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of one slice: distinct words and each word's number there, distinct languages and each word's, and its piece."""
    offs, data = offsets_and_bytes(texts)
    w = words(texts, _SEPARATOR)
    piece = np.concatenate([[0], np.cumsum(_BREAK[data])])[w.starts] + np.searchsorted(offs, w.starts, "right")
    coded, spoken = w.strings().dictionary_encode(), langs.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), spoken.dictionary.to_pylist(), np.repeat(spoken.indices.to_numpy().astype(np.int64), np.diff(w.first)), piece


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(languages, texts) of about ``size`` bytes of text, over the borders of batches."""
    held, bytes_held = [], 0
    for batch in batches:
        texts = plain(batch.column(1))
        for i, j in slices(texts, size):
            part = texts.slice(i, j - i)
            held.append((batch.column(0).slice(i, j - i).cast(pa.large_string()), part))
            bytes_held += int(offsets_and_bytes(part)[0][-1])
            if bytes_held >= size:
                yield pa.concat_arrays([a for a, _ in held]), pa.concat_arrays([b for _, b in held])
                held, bytes_held = [], 0
    if held:
        yield pa.concat_arrays([a for a, _ in held]), pa.concat_arrays([b for _, b in held])


def _language_seed(name: str) -> np.uint64:
    b = np.frombuffer(name.encode(), np.uint8)
    return hashes(b, np.array([0, len(b)]))[0] | np.uint64(1)


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _batches(batches, SLICE):
            names, word, tongues, tongue, _ = _tokens(langs, texts)
            if len(word):
                code, n = np.unique(tongue * len(names) + word, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tongues, pa.string()).take(pa.array(code // len(names))), names.take(pa.array(code % len(names))).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])
        trim()

    return _rows(docs, text, lang).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, share: int) -> set[tuple[str, str]]:
    """Words that are at least one in ``share`` of all words: ``share`` of them at most."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {(r.lang, r.word) for r in counts.where(F.col("n") * share >= total).select("lang", "word").collect()}


def suffixes(docs: DataFrame, frequent: set[tuple[str, str]], longest: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(deal, depth, lang, suffix, n) of suffixes of 2 to ``longest`` words, counted within a slice. ``deal`` says which task gets it: a hash of
    language and first ``depth`` words. Words of a suffix are parted by tabs, with ``longest - 1`` of them in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _batches(batches, SLICE):
            names, word, tongues, tongue, piece = _tokens(langs, texts)
            if len(word) < 2:
                continue
            # a column of word numbers for each place of the suffix, 0 beyond its end
            inside = np.append(piece[1:] == piece[:-1], False)
            begin = np.flatnonzero(inside)
            columns, more = [tongue[begin], word[begin] + 1], np.ones(len(begin), bool)
            for k in range(1, longest):
                more &= (begin + k < len(word)) & inside[np.minimum(begin + k - 1, len(word) - 1)]
                columns.append(np.where(more, word[np.minimum(begin + k, len(word) - 1)] + 1, 0))
            rows, n = _distinct(columns, [len(tongues)] + [len(names) + 1] * longest)
            # frequent words by language and number, a thousand at most, however many languages there are
            here = {name: t for t, name in enumerate(tongues)}
            known = [(here[spoken], w) for spoken, w in frequent if spoken in here]
            number = pc.index_in(pa.array([w for _, w in known], names.type), names).fill_null(-1).to_numpy().astype(np.int64)
            hot = np.array([t for t, _ in known], np.int64)[number >= 0] * (len(names) + 1) + number[number >= 0] + 1
            del word, tongue, piece, inside, begin, columns, more
            yield from _lots(rows, n, hot, names, tongues, longest)
        trim()

    def _lots(rows, n, hot, names, tongues, longest):
        seeds = np.array([_language_seed(t) for t in tongues], np.uint64)
        of_word = np.append(np.uint64(0), hashes(*offsets_and_bytes(names)[::-1]))
        texts = pa.concat_arrays([pa.array([""], pa.large_string()), names])
        for s in range(0, len(n), 1 << 18):
            r, m = [c[s : s + (1 << 18)] for c in rows], n[s : s + (1 << 18)]
            deal = mix(seeds[r[0]] * P + of_word[r[1]])
            is_hot = lambda k, r=r: np.isin(r[0] * (len(names) + 1) + r[k], hot)
            depth, go = np.ones(len(m), np.int8), is_hot(1)
            for k in range(2, longest + 1):
                deal = np.where(go, mix(deal * P + of_word[r[k]]), deal)
                depth += go
                go = go & is_hot(k)
            suffix = pc.binary_join_element_wise(*(texts.take(pa.array(c)) for c in r[1:]), pa.scalar("\t", pa.large_string()))
            yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(depth), pa.array(tongues, pa.string()).take(pa.array(r[0])), suffix.cast(pa.string()), pa.array(m.astype(np.int32))], names=["deal", "depth", "lang", "suffix", "n"])

    return _rows(docs, text, lang).mapInArrow(run, "deal long, depth byte, lang string, suffix string, n int")


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of whole numbers, each column under its size, and how often each occurs."""
    if np.prod([float(x) for x in sizes]) < 2**62:
        code = columns[0].copy()
        for c, size in zip(columns[1:], sizes[1:], strict=True):
            code *= size
            code += c
        code, n = np.unique(code, return_counts=True)
        out = []
        for size in reversed(sizes[1:]):
            code, c = np.divmod(code, size)
            out.append(c)
        return [code, *reversed(out)], n
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


class _Open:
    """The open prefixes of the suffixes seen last, from one batch to the next: key and count for each number of words."""

    def __init__(self, longest: int):
        self.n = {k: 0 for k in range(2, longest + 1)}
        self.key: dict[int, tuple | None] = {k: None for k in range(2, longest + 1)}
        self.row: dict[int, tuple] = {}


def phrases(dealt: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, a) of phrases of 2 to ``longest`` words that occur ``least`` times, from sorted suffixes. Rows of a phrase whose words were
    all taken into its share are parts; the others are whole and cut at ``least`` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Open(longest)
        for batch in batches:
            if batch.num_rows:
                yield from counted(batch, held)
        rows = [(*held.row[k], held.n[k]) for k in held.n if held.key[k] is not None]
        yield closed([r for r in rows if r[3] or r[4] >= least])

    def closed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64()), strict=True)], names=["lang", "phrase", "words", "part", "n"])

    def counted(batch: pa.RecordBatch, held: _Open) -> Iterator[pa.RecordBatch]:
        deal, depth, n = (batch.column(c).to_numpy() for c in (0, 1, 4))
        lang, suffix = batch.column(2).dictionary_encode(), plain(batch.column(3))
        tongue = lang.indices.to_numpy()
        offs, data = offsets_and_bytes(suffix)
        tabs = np.flatnonzero(data == 9).reshape(len(n), longest - 1)
        for k in range(2, longest + 1):
            end = tabs[:, k - 1] if k < longest else offs[1:]
            some = np.flatnonzero(end > tabs[:, k - 2] + 1)  # suffixes of so many words
            if not len(some):
                continue
            if k < longest:
                mark = np.zeros(len(data) + 1, np.int8)
                mark[offs[:-1][some]] += 1
                mark[end[some]] -= 1
                bounds = np.zeros(len(some) + 1, np.int64)
                np.cumsum(end[some] - offs[:-1][some], out=bounds[1:])
                own = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
                text = pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(own))])
            else:
                text = suffix.take(pa.array(some)) if len(some) < len(n) else suffix
            of, d = tongue[some], deal[some]
            new = np.ones(len(some), bool)
            new[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False) | (of[1:] != of[:-1]) | (d[1:] != d[:-1])
            key = (int(d[0]), lang.dictionary[of[0]].as_py(), text[0].as_py())
            first = np.flatnonzero(new)
            sums = np.add.reduceat(n[some].astype(np.int64), first)
            out = []
            if held.key[k] == key:
                sums[0] += held.n[k]
            elif held.key[k] is not None:
                out.append((*held.row[k], held.n[k]))
            at = some[first]
            part = depth[at] > k
            ends = len(first) - 1  # stays open
            keep = np.flatnonzero(part[:ends] | (sums[:ends] >= least))
            yield closed([r for r in out if r[3] or r[4] >= least])
            if len(keep):
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of[first[keep]])), text.take(pa.array(first[keep])).cast(pa.string()), pa.array(np.full(len(keep), k, np.int32)), pa.array(part[keep]), pa.array(sums[keep])], names=["lang", "phrase", "words", "part", "n"])
            last = first[-1]
            held.key[k] = (int(d[last]), lang.dictionary[of[last]].as_py(), text[last].as_py())
            held.row[k], held.n[k] = (held.key[k][1], held.key[k][2], k, bool(part[-1])), int(sums[-1])

    order = dealt.repartition(F.col("deal")).sortWithinPartitions("deal", "lang", F.desc("suffix"))
    found = written(order.mapInArrow(run, "lang string, phrase string, words int, part boolean, n long"), "phrases")
    whole = found.where("not part").select("lang", "phrase", "words", F.col("n").alias("a"))
    parts = found.where("part").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    out = written(whole.unionByName(parts), "phrase_counts")
    drop(found)
    return out


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP, text: str = "text", lang: str = "lang", hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    counts = written(word_counts(docs, text, lang), "words")
    frequent = _frequent(counts, hot)
    found = phrases(suffixes(docs, frequent, longest, text, lang), longest, least)
    singles = counts.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("a"))
    all_ = written(singles.unionByName(found), "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    drop(found)

    # the parts of each cut, each looked up by itself
    word = F.split("phrase", "\t")
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(word, F.lit(1), k), "\t").alias("first"), F.array_join(F.slice(word, k + 1, F.col("words") - k), "\t").alias("rest"))
    candidates = all_.where("words > 1")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), cut)).alias("c")).select("lang", "phrase", "a", "c.*")
    of = lambda name, value: all_.select(F.col("lang").alias("g"), F.col("phrase").alias(name + "_"), F.col("a").alias(value))
    first, rest = of("first", "l"), of("rest", "r")
    half = written(cuts.join(first, (F.col("lang") == F.col("g")) & (F.col("first") == F.col("first_"))).select("lang", "phrase", "a", "k", "rest", "l"), "cuts")
    both = half.join(rest, (F.col("lang") == F.col("g")) & (F.col("rest") == F.col("rest_")))
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    both = both.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")).cast("decimal(31,0)")).withColumn("down", exact("l") * exact("r")).withColumn("score", F.expr("up div down"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("x")
    scores = both.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "x.score", "x.l", "x.r")

    # phrases inside longer ones
    part = lambda i, m: F.array_join(F.slice(word, i, m), "\t")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: part(i, m))))
    longer = candidates.where("words > 2").select("lang", "a", F.explode(inner).alias("inside")).groupBy(F.col("lang").alias("g"), "inside").agg(F.max("a").alias("most"))
    scores, longer = written(scores, "scores"), written(longer, "longer")
    kept = scores.join(longer, (F.col("lang") == F.col("g")) & (F.col("phrase") == F.col("inside")), "left").where(F.col("most").isNull() | (100 * F.col("most") < absorbed * F.col("a")))
    kept = kept.select("lang", F.translate("phrase", "\t", " ").alias("phrase"), "a", "l", "r", "score")
    # the first of each share, then of the language, so that no task gets all of a language
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    kept = kept.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    out = kept.join(totals, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
