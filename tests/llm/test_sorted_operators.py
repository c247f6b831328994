"""Spelling variants, repeated windows and collocations against brute force; secrets of very long texts."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggline.llm import collocations, repeated_windows, secret_scan, spelling_variants


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def clashing(df):
    """With further columns that are named like the operators' own."""
    names = ("id", "th", "t", "n", "word", "words", "block", "lang_", "part", "core", "whole", "rows", "g", "a", "rank", "share")
    return df.select("*", *(F.lit("own").alias(n) for n in names if n not in df.columns))


# -- spelling variants ---------------------------------------------------------------------------------------------------


def spelled(rows):
    times = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            times[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in times.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        p = 0
        while p < len(a) and a[p] == b[p]:
            p += 1
        return len(b) - len(a) <= 1 and (a != b and a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :])

    others = {w: [v for v in n if v != w and near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(others[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return sorted(out)


def misspelt(r):
    letters, pool = "abcdéÿ×", []
    for _ in range(40):
        w = "".join(r.choice(letters) for _ in range(r.randint(7, 12)))
        pool += [w] * r.choice([2, 50, 400])
        for _ in range(r.randint(1, 10)):
            p, kind = r.randrange(len(w) + 1), r.randrange(3)
            pool += [w[:p] + (r.choice(letters) if kind else "") + w[p + (kind < 2) :]] * r.choice([1, 2, 3, 30])
    pool += ["dabcdabc"] * 400 + ["dabcdabd"] * 30 + ["dabcdadd"] * 2  # a form of a form
    pool += ["aaaaaaa" + c for c in letters for _ in range(3)] + ["x" * 300] * 40 + ["x" * 301] * 3 + ["bab" * 2000] * 2 + ["short"] * 9
    r.shuffle(pool)
    texts = [" ".join(x.upper() if x.isascii() and r.random() < 0.1 else x for x in pool[k : k + 40]) + r.choice(["", "!", " x"]) for k in range(0, len(pool), 40)]
    return [(None if k == 3 else k // 2, t) for k, t in enumerate(texts)] + [(1, None), (2, ""), (0, texts[0]), (0, texts[0])]


@pytest.mark.parametrize("block", [16, 128])
def test_variants(spark, monkeypatch, block):
    # blocks are subdivided from 16 words on, which is more than there are letters here
    monkeypatch.setattr(spelling_variants, "BLOCK", block)
    rows = misspelt(random.Random(block))
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = sorted(tuple(x) for x in spelling_variants.variants(df).collect())
    want = spelled(rows)
    assert got == want and any(x[1] for x in want) and any(x[1] != x[2] for x in want if x[1])


def test_variants_of_nothing(spark):
    empty = spelling_variants.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and dict(empty.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    alone = spelling_variants.variants(spark.createDataFrame([(1, "unaltered unaltered"), (None, None)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in alone] == [("unaltered", None, "unaltered", 2, 0, None)]


def test_joined_crc():
    r = random.Random(3)
    a, b = ([r.randbytes(r.randint(0, 255)) for _ in range(500)] for _ in range(2))
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = spelling_variants.joined_crc32(crc(a), crc(b), np.array([len(x) for x in b]))
    assert (got == crc([x + y for x, y in zip(a, b, strict=True)])).all()


# -- repeated windows ----------------------------------------------------------------------------------------------------


def cut(rows, window):
    starts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        starts.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if starts[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def patched(r):
    """Texts of whole, cut, edited and repeated passages, some bytes over and over."""
    rand = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    pool, texts = [rand(r.randint(150, 900)) for _ in range(10)], []
    for _ in range(90):
        t = ""
        for _ in range(r.randint(0, 5)):
            p, kind = r.choice(pool), r.random()
            at = r.randrange(len(p))
            over = r.choice(["a" * r.randint(190, 420), "ab" * r.randint(90, 240), (rand(7) * 80)[: r.randint(199, 420)]])
            edited = "".join(c if r.random() > 1 / 200 else "x" for c in p)
            t += p if kind < 0.3 else p[at : at + r.randint(150, 260)] if kind < 0.5 else edited if kind < 0.7 else over if kind < 0.75 else rand(r.randint(10, 300))
        texts.append(t)
    rows = [(None if r.random() < 0.05 else 3 if r.random() < 0.05 else k, t) for k, t in enumerate(texts)]
    return rows + rows[5:8] + [(500, None), (501, ""), (502, pool[0][:199])]


@pytest.mark.parametrize("part", [300, 1 << 20])
def test_repeated_windows(spark, monkeypatch, part):
    monkeypatch.setattr(repeated_windows, "PART", part)  # texts are cut into parts of 300 bytes
    rows = patched(random.Random(part))
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = sorted((tuple(x) for x in repeated_windows.digest(repeated_windows.without_repeats(df)).collect()), key=str)
    assert got == cut(rows, 200) and sum(x[2] for x in got) > 0


def test_repeated_windows_edges(spark):
    assert repeated_windows.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = random.Random(8)
    text = "".join(r.choice("abcdef ") for _ in range(1000))
    rows = [(1, text), (2, text[:199]), (3, "z" + text[300:500] + "z"), (4, text[500:699] + "q")]
    found = {x.doc_id: x for x in repeated_windows.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {k: [(s.start, s.end) for s in x.spans] for k, x in found.items()}
    assert spans == {1: [(300, 500)], 2: [], 3: [(1, 201)], 4: []}
    assert bytes(found[1].kept).decode() == text[:300] + text[500:] and bytes(found[3].kept) == b"zz"
    # one text of equal bytes alone, and a long one
    rows = [(1, "a" * 200), (2, "b" * 201), (3, "xy" * 1_000_000)]
    got = {x.doc_id: x.n_removed for x in repeated_windows.digest(repeated_windows.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: 0, 2: 201, 3: 2_000_000}


# -- collocations ----------------------------------------------------------------------------------------------------------


def collocated(rows, longest, least, top):
    n, f = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for i in range(len(w)) for m in range(1, min(longest, len(w) - i) + 1))
    found, inside = {}, Counter()
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            found[lang, p] = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], a)
    out = []
    for lang in n:
        some = [(-s, -f[g, p], " ".join(p).encode(), p, k) for (g, p), (s, k) in found.items() if g == lang and 100 * inside[g, p] < 50 * f[g, p]]
        for rank, (s, a, _, p, k) in enumerate(sorted(some)[:top], 1):
            out.append((lang, rank, " ".join(p), -a, f[lang, p[:k]], f[lang, p[k:]], n[lang], -s))
    return sorted(out)


def chatter(r):
    vocabulary, rows = [f"w{k}" for k in range(40)] + ["É", "Ünï", "a'b", "x\x01", "-"], []
    for _ in range(500):
        w = []
        while len(w) < r.randint(0, 60):
            w += r.choice([["of", "the"], ["New", "york", "City"], ["same"] * r.randint(1, 5), [vocabulary[int(r.random() ** 2 * 45)]], [r.choice(vocabulary)]])
        t = "".join(x + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!", "\x0b"]) for x in w)
        rows.append((r.choice(["en", "en", "fr", None, "und", "a\tb"]), r.choice([t] * 6 + [None, ""])))
    return rows + rows[:3]


@pytest.mark.parametrize(("longest", "hot", "top", "size"), [(3, 1000, 2000, 2000), (3, 20, 7, 1 << 20), (4, 20, 2000, 1 << 20)])
def test_collocations(spark, monkeypatch, longest, hot, top, size):
    # small slices, frequent words whose suffixes are dealt by further words, longer phrases
    monkeypatch.setattr(collocations, "SLICE", size)
    rows = chatter(random.Random(longest))
    df = clashing(spark.createDataFrame(rows, "lang string, text string")).repartition(3)
    got = sorted(tuple(x) for x in collocations.collocations(df, longest=longest, top=top, hot=hot).collect())
    assert got == collocated(rows, longest, 10, top) and len(got) > 20


def test_collocations_edges(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0
    # equal scores and counts are ranked by the bytes of the phrase, and a very long text counts whole
    long = "b a. é z. B c! " * 20_000
    got = [tuple(x) for x in collocations.collocations(spark.createDataFrame([(None, long)], "lang string, text string")).orderBy("rank").collect()]
    assert got == [("und", 1, "é z", 20_000, 20_000, 20_000, 120_000, 1_000_000), ("und", 2, "b a", 20_000, 40_000, 20_000, 120_000, 500_000), ("und", 3, "b c", 20_000, 40_000, 20_000, 120_000, 500_000)]


def test_many_languages(spark):
    """A language for each text: memory follows the words, not languages times words."""
    rows = [(f"l{k}", f"alpha beta{k} " * 12 + f"own{k}") for k in range(3000)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).select("lang", "phrase", "a", "n").collect()
    # alpha beta 12 times, beta alpha 11; both are inside longer phrases at least half as often
    assert len({r.lang for r in got}) == 3000 and {(r.a, r.n) for r in got} <= {(12, 25), (11, 25), (10, 25)}


def test_distinct_rows():
    """By one number a row where it fits, else by sorting columns."""
    r = np.random.default_rng(2)
    columns = [r.integers(0, 3, 5000) for _ in range(4)]
    for sizes in ([3] * 4, [3, 1 << 20, 1 << 20, 1 << 30]):
        rows, n = collocations._distinct(columns, sizes)
        assert Counter(zip(*(c.tolist() for c in columns), strict=True)) == dict(zip(zip(*(c.tolist() for c in rows), strict=True), n.tolist(), strict=True))


# -- secrets -----------------------------------------------------------------------------------------------------------------


def test_many_secrets_masked(spark):
    """40,000 in one text, some of them touching."""
    parts, want = [], []
    for k in range(40_000):
        value = hashlib.md5(str(k).encode()).hexdigest()
        if k % 1000 == 0:
            parts.append(f"é token={value}AKIA{'Q' * 16} ")
            want.append("é [SECRET] ")
        else:
            parts.append(f"é𝔘 {value} ")
            want.append("é𝔘 [SECRET] ")
    df = spark.createDataFrame([(1, "".join(parts), "o", "l"), (2, parts[1], "p", "l"), (3, "clean", "p", "l")], "doc_id long, text string, source string, lang string")
    began = time.time()
    got = {r.doc_id: r.text for r in secret_scan.redact(df, F.col("source"), F.col("lang")).collect()}
    took = time.time() - began
    shared = "".join(want).split(" ")
    assert got[3] == "clean" and got[2] == "é𝔘 [EXAMPLE] "
    shared[3] = "[EXAMPLE]"  # the value that two owners hold
    assert got[1] == " ".join(shared) and took < 90
