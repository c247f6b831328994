"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A document's set holds its distinct k-word shingles. Its signature holds b-bit symbols, one per hash function.
The signature is split into chunks; by pigeonhole, two signatures that differ in at most
``chunks * (errors + 1) - 1`` symbols agree on some chunk up to ``errors`` symbols, so all choices of ``errors``
symbols to leave out are enumerated and the rest of the chunk becomes a key: every pair within that distance
shares a key. Pairs that share one are first held against a 1-bit signature of all hash functions
(``radius``), then confirmed by the exact Jaccard similarity of whole sets.

No key's rows are expanded into all their pairs. Equal sets are one node. Shingles that a node shares with no
other node of a shared key can't be in any intersection, and parities of hashed buckets bound from below what only
one of two sets holds; nodes and pairs that these bounds rule out are left, which no link can be lost by. First, each node is compared
with the node of its key that has the greatest part in common with others (in a family of copies, the one least
edited); confirmed links are joined into components. Second, in keys that still hold several components, rows
outside the component of the key's hub are compared with the rows of other components. A pair left out this way
lies within one component already, so components are those of all links. Both steps are equi-joins whose skew
Spark can split.

Null and empty texts have no shingles and link with nothing. Rows without a key value are returned with a null
component. Repeated rows are copies of each other: all are returned, under one component. Of several texts under one
key, the one of least hash is compared, and its component holds for all. Very long texts are handled in memory that
follows the text. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, drop, written
from .worker import cache, trimmed
from .words import mix, plain, shingle_set, slices, words


@dataclass(frozen=True)
class Setting:
    """At a similarity of 0.75 a pair misses all of the 14 x 6 keys with a probability of about 2e-5."""

    k: int = 5
    numerator: int = 75
    denominator: int = 100
    chunks: int = 14
    symbols: int = 6
    hashes: int = 128
    #: Of 128 bits; pairs at a similarity of 0.75 differ in 16 on average, with a deviation of 3.7.
    radius: int = 36

    @property
    def keys(self) -> int:
        return self.chunks * self.symbols


_BLOCK = 2048
#: 1024 buckets.
PARITY_LONGS = 16


def minhashes(u: np.ndarray, n: int) -> np.ndarray:
    """Least value of each of n hash functions over a set of hashes that isn't empty."""
    with np.errstate(over="ignore"):
        a = (mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
        b = mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))[:, None]
        least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(u), _BLOCK):
            np.minimum(least, (u[None, i : i + _BLOCK] * a + b).min(axis=1), out=least)
        return least


def parities(u: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_LONGS buckets whether it holds an odd number of a set's hashes. An element in one of two
    sets only turns one bit, so that bits that differ never outnumber such elements."""
    odd = np.bincount((mix(u) >> np.uint64(64 - PARITY_LONGS.bit_length() - 5)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def keys_of(least: np.ndarray, s: Setting) -> np.ndarray:
    """(rows, chunks * symbols) keys: each chunk without each of its symbols (one error allowed)."""
    with np.errstate(over="ignore"):
        symbol = (mix(least[:, : s.keys]) & np.uint64(0xFFFF)).reshape(len(least), s.chunks, s.symbols)
        weight = (mix(np.arange(1000, 1000 + s.keys, dtype=np.uint64)) | np.uint64(1)).reshape(1, s.chunks, s.symbols)
        term = mix(symbol + np.uint64(1) + weight) * weight
        return mix(term.sum(axis=2, dtype=np.uint64)[:, :, None] - term + weight).reshape(len(least), s.keys)


def profiles(docs: DataFrame, s: Setting, text: str, key: str) -> DataFrame:
    """(key, th, n_shingles, f1, f2, s1, s2, keys, parity) per row; all but the first three are null without shingles."""

    def run(batches):
        cache("minhash_dedup")
        for batch in batches:
            texts, at = plain(batch.column(1)), 0
            for i, j in slices(texts):
                w = words(texts[i:j])
                h = w.hashes()
                sets = [shingle_set(h[a:b], s.k) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                n = np.array([len(u) for u in sets], np.int64)
                full = np.flatnonzero(n > 0)
                least = np.stack([minhashes(sets[d], s.hashes) for d in full]) if len(full) else np.zeros((0, s.hashes), np.uint64)
                bits = np.packbits((mix(least) >> np.uint64(40) & np.uint64(1)).astype(np.uint8), axis=1)
                sketch = bits.view("<i8") if len(full) else np.zeros((0, s.hashes // 64), np.int64)
                with np.errstate(over="ignore"):
                    prints = np.array([[mix(sets[d]).sum(dtype=np.uint64), mix(sets[d] ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for d in full], np.uint64).reshape(len(full), 2).view(np.int64)
                keys = keys_of(least, s).view(np.int64)
                parity = np.stack([parities(sets[d]) for d in full]) if len(full) else np.zeros((0, PARITY_LONGS), np.int64)
                place = np.full(len(n), -1, np.int64)
                place[full] = np.arange(len(full))
                take = pa.array(place, mask=place < 0)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())).take(take) for x in (keys, parity)]
                columns = [pa.array(np.ascontiguousarray(x)).take(take) for x in (prints[:, 0], prints[:, 1], sketch[:, 0], sketch[:, 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(n)], batch.column(2)[at : at + len(n)], pa.array(n), *columns, *lists], names=[key, "th", "n_shingles", "f1", "f2", "s1", "s2", "keys", "parity"])
                at += len(n)

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text), F.xxhash64(F.col(text).cast("string")).alias("th")).mapInArrow(trimmed(run), f"`{key}` long, th long, n_shingles long, f1 long, f2 long, s1 long, s2 long, keys array<long>, parity array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, s: Setting) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough. texts: (id, text), one row per id."""

    def run(batches):
        held: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            one, two, b_ids, at = plain(batch.column(2)), plain(batch.column(3)), batch.column(1).to_pylist(), 0
            keep = np.zeros(len(one), bool)
            for i, j in slices(one):
                w = words(one[i:j])
                h = w.hashes()
                for d in range(j - i):
                    if b_ids[at] != held[0]:
                        held = (b_ids[at], shingle_set(words(two[at : at + 1]).hashes(), s.k))
                    u, v = shingle_set(h[w.first[d] : w.first[d + 1]], s.k), held[1]
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    keep[at] = both > 0 and s.denominator * both >= s.numerator * (len(u) + len(v) - both)
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(trimmed(run), "a long, b long")


def _sole(texts: DataFrame, s: Setting) -> DataFrame:
    """(id, u): how many of a node's shingles no other of these nodes holds, where there are any."""

    def run(batches):
        for batch in batches:
            one, at = plain(batch.column(1)), 0
            for i, j in slices(one):
                w = words(one[i:j])
                h = w.hashes()
                sets = [shingle_set(h[a:b], s.k).view(np.int64) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(sets)], pa.array(sets, pa.list_(pa.int64()))], names=["id", "hashes"])
                at += len(sets)

    each = texts.select("id", "text").mapInArrow(trimmed(run), "id long, hashes array<long>").select("id", F.explode("hashes").alias("h"))
    sole = each.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    return sole.where("id = last").groupBy("id").agg(F.count("*").alias("u"))


def _possible(s: Setting) -> F.Column:
    """Bounds that every pair of enough similarity meets: what two sets share is in common with others in both,
    so m bounds the intersection; the parities bound what only one of them holds; and the signatures are near."""
    least, total = F.least("m", "m2"), F.col("n") + F.col("n2")
    differ = lambda names: sum((F.bit_count(F.col(f"bits.{c}").bitwiseXOR(F.col(f"bits2.{c}"))) for c in names), F.lit(0))
    return (
        (least * (s.numerator + s.denominator) >= total * s.numerator)
        & (differ(("s1", "s2")) <= s.radius)
        & (differ(f"p{i}" for i in range(PARITY_LONGS)) * (s.denominator + s.numerator) <= total * (s.denominator - s.numerator))
    )


def near_duplicates(docs: DataFrame, setting: Setting = Setting(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (least key reachable by links), kept."""
    s = setting
    rows = written(profiles(docs, s, text, key).withColumnRenamed(key, "id"), "profiles")
    with_set = rows.where("n_shingles > 0 and id is not null")
    chosen = with_set.groupBy("id").agg(F.min(F.struct("th", "f1", "f2")).alias("f")).select("id", "f.*")
    chosen = written(chosen, "chosen")
    classes = chosen.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    member = written(chosen.join(classes, ["f1", "f2"]).select("id", "rep", "th"), "members")
    drop(chosen)
    reps = with_set.join(member.where("id = rep").select("id", "th"), ["id", "th"], "left_semi").dropDuplicates(["id"])
    reps = written(reps.select(F.col("id").alias("rep"), "th", F.col("n_shingles").alias("n"), "s1", "s2", "parity", "keys"), "nodes")

    keyed = reps.select("rep", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    ends = written(ends, "ends")
    shared = written(keyed.join(ends, "key").select("key", "rep"), "keys")
    # texts of the nodes that share a key, read once
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    needed = written(reps.select("rep", "th").join(shared.select("rep").distinct(), "rep").withColumnRenamed("rep", "id"), "needed")
    texts = written(source.withColumn("th", F.xxhash64("text")).join(needed.hint("merge"), ["id", "th"], "left_semi").dropDuplicates(["id"]), "texts")
    needed_table, needed = needed, needed.select("id")
    bits = F.struct("s1", "s2", *(F.col("parity")[i].alias(f"p{i}") for i in range(PARITY_LONGS))).alias("bits")
    nodes = _sole(texts, s).join(reps.select(F.col("rep").alias("id"), "n", bits), "id", "right").select(F.col("id").alias("rep"), "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("m"), "bits")
    nodes = nodes.join(needed.withColumnRenamed("id", "rep"), "rep", "left_semi")
    nodes = written(nodes.where(F.col("m") * s.denominator >= F.col("n") * s.numerator), "nodes")

    # first: each node with the node of its key that has most in common with others
    shared2 = written(shared.join(nodes, "rep"), "keys")
    hub = shared2.groupBy("key").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("f"), (-F.col("rep")).alias("r"), "n", "m", "bits")).alias("x"))
    hub = hub.select("key", (-F.col("x.r")).alias("hub"), F.col("x.n").alias("n2"), F.col("x.m").alias("m2"), F.col("x.bits").alias("bits2"))
    hub = written(hub, "hubs")
    first = shared2.join(hub, "key").where("rep <> hub").where(_possible(s)).select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    first = written(first, "pairs")
    links = written(_confirmed(first, texts, s), "links")
    label = components(links)

    # second: what lies outside the component of its key's hub, with the other components of the key
    named = shared2.join(hub.select("key", "hub"), "key").join(label.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("c"))).alias("of_hub")).where("c0 < c1")
    mixed = written(mixed.select("key", "of_hub"), "mixed")
    left = written(named.join(mixed, "key").drop("hub"), "mixed")
    outside = left.where("c <> of_hub").select("key", F.col("rep").alias("b"), F.col("c").alias("d"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("bits").alias("bits2"))
    second = left.join(outside, "key").where(F.col("c") != F.col("d")).where(_possible(s))
    second = second.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = written(_confirmed(second, texts, s), "links")
    final = label if more.isEmpty() else components(links.unionByName(more))

    named = member.join(final, member["rep"] == final["node"], "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "n_shingles").join(named, "id", "left")
    component = F.coalesce(F.col("component_id"), F.col("id"))
    out = written(out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")), "near_duplicates")
    drop(rows, member, reps, ends, shared, needed_table, texts, nodes, shared2, hub, first, links, mixed, left, more, *{id(t): t for t in (label, final)}.values())
    return out
