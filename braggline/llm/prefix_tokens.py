"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair pieces.

Within a piece, the tokens of each prefix end in exactly one token that is compatible with the last token of
the prefix before it; so ``count[i] = count[i - len(last[i])] + 1`` holds for every byte i and one sweep answers
all prefixes. Two tokens are compatible if encoding their joined bytes gives the two again. Pieces add up, as
no merge crosses them. Distinct pieces are swept once per worker while remembered; a sweep of a piece is linear in
its length, and so are all counts of a text, however long its pieces are.

Null texts count as empty (0 tokens); repeated rows are counted as they come, null ids stay null; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import cache
from .words import SAME, offsets_and_bytes, plain, slices, words

#: The public pre-tokenisation pattern of byte-level BPE, and its byte alphabet (printable bytes stand for themselves).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
BLANKS = regex.compile(r"\s+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
REMEMBERED = 500_000
#: A rank after all others: the token is whole.
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte; bytes that don't print take the characters from 256 on."""
    rest = [b for b in range(256) if b not in _PRINTABLE]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one vocabulary file of byte-level BPE without normaliser (``byte_bpe_50k.json``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        parts = {a + b: (a, b) for a, b in reversed(self.rank)}
        # tokens that merging their own bytes leads to: bytes, and joins of such tokens
        self.right: dict[bytes, list[tuple[bytes, int]]] = {}
        self.left: dict[bytes, list[tuple[bytes, int]]] = {}
        for t in sorted(self.ids, key=len):
            if len(t) == 1:
                self.right[t] = self.left[t] = [(t, NEVER)]
            elif t in parts and (x := parts[t])[0] in self.right and x[1] in self.right:
                r = self.rank[x]
                self.right[t] = [(t, NEVER), *((y, min(r, u)) for y, u in self.right[x[1]])]
                self.left[t] = [(t, NEVER), *((y, min(r, u)) for y, u in self.left[x[0]])]
        self.longest: dict[bytes, int] = {}
        for t in self.right:
            self.longest[t[-2:]] = max(self.longest.get(t[-2:], 1), len(t))
        self.tokens = list(self.right)
        self.number = {t: i for i, t in enumerate(self.tokens)}
        #: By the numbers of two tokens, in one: whether they are compatible.
        self.fits: dict[int, bool] = {}
        self.swept: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether a and b stay apart when their joined bytes are encoded.

        The border lies between a part on the right edge of a and one on the left edge of b; a merge of the two
        crosses it if its rank comes before the ranks at which the parts themselves are merged away. Of equal
        merges the left one goes first.
        """
        rank = self.rank
        for x, until in self.right[a]:
            for y, upto in self.left[b]:
                if (r := rank.get((x, y))) is not None and r < until and r <= upto:
                    return False
        return True

    def sweep(self, piece: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... len(piece) bytes of one piece."""
        counts, last = [0], [-1]
        number, fits, longest = self.number.get, self.fits, self.longest.get
        if len(fits) > 1_000_000:
            fits.clear()
        for i in range(1, len(piece) + 1):
            j = max(0, i - longest(piece[max(0, i - 2) : i], 1))
            while j < i:  # the longest token first
                if (t := number(piece[j:i])) is not None:
                    if not j:
                        break
                    pair = last[j] << 32 | t
                    if (ok := fits.get(pair)) is None:
                        ok = fits[pair] = self.compatible(self.tokens[last[j]], self.tokens[t])
                    if ok:
                        break
                j += 1
            else:
                raise ValueError("a byte of the text has no token")
            counts.append(counts[j] + 1)
            last.append(t)
        return counts

    def unit(self, text: str) -> int:
        """Tokens of a text between specials."""
        n, known = 0, self.pieces
        for piece in PIECES.findall(text):
            if (size := known.get(piece)) is None:
                if len(known) > REMEMBERED:
                    known.clear()
                size = known[piece] = self.sweep(piece.encode())[-1]
            n += size
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings are one token each, as the library has it by default."""
        if self.cut is None:
            return self.unit(text)
        return len(self.cut.findall(text)) + sum(map(self.unit, self.cut.split(text)))

    def _ordinary_counts(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of a text whose special strings count as ordinary characters.

        A cut leaves all pieces before it as they are, but for two cases: white space before a cut is one piece with
        the white space before it, and a cut contraction falls apart. So each piece, and each run of white space as a
        piece, is swept once, and a sweep answers every cut inside it.
        """
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # bytes before each character
        out, known = np.zeros(len(text) + 1, np.int64), {}

        def swept(first: int, end: int) -> np.ndarray:
            """Counts at each character's end of a stretch taken as one piece."""
            piece = text[first:end]
            if (counts := known.get(piece)) is None:
                if len(known) > REMEMBERED // 10:
                    known.clear()
                counts = known[piece] = np.array(self.sweep(piece.encode()), np.int64)[at[first + 1 : end + 1] - at[first]]
            return counts

        blanks = [m.span() for m in BLANKS.finditer(text)]
        total = run = 0
        for m in PIECES.finditer(text):
            first, end = m.span()
            counts = swept(first, end)
            solid = first
            if run < len(blanks) and blanks[run][0] <= first:
                if first == blanks[run][0]:
                    out[first + 1 : blanks[run][1] + 1] = total + swept(*blanks[run])
                solid = min(end, blanks[run][1])
                run += end >= blanks[run][1]
            out[solid + 1 : end + 1] = total + counts[solid - first :]
            if m[0] in CONTRACTIONS:
                for i in range(first + 1, end):
                    out[i] = total + self.unit(text[first:i])
            total += int(counts[-1])
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """``out[i]``: tokens of ``text[:i]`` encoded by itself, for every i from 0 to len(text), in time linear in the
        text. A cut inside a special string leaves ordinary characters."""
        out = np.zeros(len(text) + 1, np.int64)
        done = base = 0
        specials = [m.span() for m in self.cut.finditer(text)] if self.cut else []
        for a, b in [*specials, (len(text), len(text) + 1)]:
            out[done:b] = base + self._ordinary_counts(text[done : b - 1])
            if b <= len(text):
                base = out[b] = out[a] + 1
                done = b
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        return text[: int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])]

    def column(self, texts: pa.Array) -> np.ndarray:
        """Token counts of whole texts. White space and the word after it form a unit; equal units are swept once."""
        texts = plain(texts)
        out = np.zeros(len(texts), np.int64)
        slow = np.zeros(len(texts), bool)
        # other white space than ASCII's, and specials, can join what a cut at ASCII white space parts
        for p in ("[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]", *map(regex.escape, self.special)):
            slow |= pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(slow):
            out[i] = self.count(texts[int(i)].as_py())
        for i, j in slices(texts, 4 << 20):
            part = texts[i:j]
            offs, data = offsets_and_bytes(part)
            w = words(part, fold=SAME)
            # a unit runs from the end of the word before (or the start of its text) to the end of its word
            n = np.diff(w.first)
            has = n > 0
            begin = np.concatenate([[0], w.ends])[:-1] if len(w.ends) else np.zeros(0, np.int64)
            begin[w.first[:-1][has]] = offs[:-1][has]
            tail = np.where(has, w.ends[np.maximum(w.first[1:] - 1, 0)] if len(w.ends) else 0, offs[:-1])
            units = self._slices(data, begin, w.ends)
            size = self._sizes(units)
            sums = np.concatenate([[0], np.cumsum(size)])
            total = sums[w.first[1:]] - sums[w.first[:-1]]
            rest = np.flatnonzero((tail < offs[1:]) & ~slow[i:j])
            for d in rest:
                total[d] += self.unit(data[tail[d] : offs[d + 1]].tobytes().decode())
            out[i:j] = np.where(slow[i:j], out[i:j], total)
        return out

    @staticmethod
    def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """Strings of byte ranges that are in order and don't overlap."""
        keep = np.zeros(len(data) + 1, np.int8)
        np.add.at(keep, begin, 1)
        np.add.at(keep, end, -1)
        offsets = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=offsets[1:])
        return pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(keep[:-1]) > 0])])

    def _sizes(self, units: pa.Array) -> np.ndarray:
        if not len(units):
            return np.zeros(0, np.int64)
        coded = units.dictionary_encode()
        swept = self.swept
        if len(swept) > REMEMBERED:
            swept.clear()
        sizes = []
        for u in coded.dictionary.to_pylist():
            if (n := swept.get(u)) is None:
                n = swept[u] = self.unit(u)
            sizes.append(n)
        return np.array(sizes, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def counter(path: str) -> PrefixCounter:
    held = cache("prefix_tokens")
    if path not in held:
        held[path] = PrefixCounter(path)
    return held[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text."""

    def run(batches):
        for batch in batches:
            t = plain(batch.column(1))
            n = counter(tokenizer).column(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets_and_bytes(t)[0])), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, counts): the token count of every prefix, by characters; answers any truncation without encoding again."""

    def run(batches):
        for batch in batches:
            c, texts = counter(tokenizer), plain(batch.column(1))
            for i, j in slices(texts):
                counts = [c.prefix_counts(t) for t in texts[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(counts, pa.list_(pa.int64()))], names=[key, "counts"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` long, counts array<long>")
