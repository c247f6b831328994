"""Embedding near-duplicates by lattice hashing: random projections decoded to E8 lattice points, in several tables.

A table projects the unit vector onto 16 random orthonormal directions and decodes both halves to the nearest
point of a scaled E8 lattice; the pair of points names a cell. A vector stands in its own cell and probes, for each
half, the neighbouring lattice cell next nearest to it. Two vectors meet in a table if the cell of one is the cell
or a probed cell of the other. Whatever meets is verified by the cosine of the full vectors in double precision.

Vectors don't travel to their cells at first, but sketches of 16 bytes: a further projection onto 16 orthonormal
directions, rounded. A projection never lengthens the distance of two vectors, so that a pair whose sketches are
farther apart than vectors of the wanted cosine can be, with the rounding added, is no link. Only vectors that have
a possible partner in a cell are then sent there whole.

Equal vectors are one node with a multiplicity. A cell of many nodes is cut into blocks of ``BLOCK`` nodes and
every pair of blocks is a group of its own, so no group exceeds two blocks and no cell is capped. Links are not
written out as pairs: of the tables in which a pair meets only the first counts it, so groups return sums per node,
and for the components only links that join what the group hasn't joined yet.

Vectors that are null, zero, or hold null or non-finite components link with nothing and are returned with no
links, under their own id; so are, of several vectors under one id, all but that of least hash. Vectors of different
lengths never meet. Repeated rows count as vectors of their own; null ids are returned with a null component. Empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, drop, written
from .words import mix

#: Pairs at a cosine of 0.95 meet in a table with a probability of 0.55 (64 dimensions), so that 20 tables miss one in 10 million;
#: unrelated pairs meet in one of a thousand.
TABLES, HALVES, SCALE = 20, 2, 0.30
COSINE = 0.95
BLOCK, CHUNK = 512, 50_000
#: Values of a sketch, the step that they are rounded to, and the rows of a group up to which pairs are compared one by one.
SKETCH, STEP, SMALL = 16, 0.5 / 127, 64
#: Rows of small groups that are compared at once.
LOT = 2048


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to rows of 8 numbers, doubled to be integers: E8 is D8 and D8 shifted by a half."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
        if len(odd):
            off = y[odd] - r[odd]
            worst = np.abs(off).argmax(axis=1)
            at = np.arange(len(odd))
            r[odd, worst] += np.where(off[at, worst] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return (2 * np.where(near[:, None], a, b)).astype(np.int64)


def nearest_root(r: np.ndarray) -> np.ndarray:
    """Of the 240 shortest vectors of E8 the one that points most along each row, doubled to be integers: +-1 at two
    places, or halves with an even number of minus signs."""
    size, at = np.abs(r), np.arange(len(r))
    sign = np.where(r < 0, -1, 1)
    two = np.argpartition(-size, 1, axis=1)[:, :2]
    pair = np.zeros(r.shape, np.int64)
    for k in range(2):
        pair[at, two[:, k]] = 2 * sign[at, two[:, k]]
    halves, least = sign.astype(np.int64), size.argmin(axis=1)
    odd = (r < 0).sum(axis=1) % 2 == 1
    halves[at[odd], least[odd]] *= -1
    along = size[at[:, None], two].sum(axis=1) >= size.sum(axis=1) / 2 - np.where(odd, size[at, least], 0)
    return np.where(along[:, None], pair, halves)


@lru_cache(maxsize=4)
def directions(n: int) -> np.ndarray:
    """(TABLES, n, 8 * HALVES): random directions, orthonormal within a table where the dimension allows."""
    r = np.random.default_rng(11)
    out = []
    for _ in range(TABLES):
        m = r.normal(size=(n, 8 * HALVES))
        out.append(np.linalg.qr(m)[0] if n >= 8 * HALVES else m / np.sqrt(n))
    return np.stack(out) * np.sqrt(n / 64)


def cells(unit: np.ndarray) -> np.ndarray:
    """(rows, TABLES, 1 + HALVES) cell numbers: the own cell, then the probed ones; those of other lengths are others."""
    n = unit.shape[1]
    out = np.zeros((len(unit), TABLES, 1 + HALVES), np.uint64)
    weight = mix(np.arange(1, 8 * HALVES + 2, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            x = unit @ directions(n)[t] / SCALE
            name, step = np.full(len(unit), np.uint64(t + 1) * weight[-1] + mix(np.array([n], np.uint64))[0]), []
            for h in range(HALVES):
                part = x[:, 8 * h : 8 * h + 8]
                point = nearest_e8(part)
                way = nearest_root(part - point / 2)
                w = weight[8 * h : 8 * h + 8]
                name = name + (point.astype(np.uint64) * w).sum(axis=1, dtype=np.uint64)
                step.append((way.astype(np.uint64) * w).sum(axis=1, dtype=np.uint64))
            out[:, t, 0] = mix(name)
            for h in range(HALVES):
                out[:, t, 1 + h] = mix(name + step[h])
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@lru_cache(maxsize=4)
def _sketch_directions(n: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(12).normal(size=(n, min(n, SKETCH))))[0]


def sketches(unit: np.ndarray) -> np.ndarray:
    """(rows, 2) longs: a projection in steps of ``STEP``; cut off at 127 of them, which lengthens no distance either."""
    out = np.zeros((len(unit), SKETCH), np.int8)
    x = unit @ _sketch_directions(unit.shape[1])
    out[:, : x.shape[1]] = np.clip(np.rint(x / STEP), -127, 127)
    return out.view(np.int64)


def sketch_limit(cosine: float) -> float:
    """The square of the distance in steps that sketches of a link can't exceed."""
    return (np.sqrt(max(0.0, 2 - 2 * cosine)) / STEP + np.sqrt(SKETCH)) ** 2 + 1e-6


def placed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, times, vec) with ``cells``, own and probed, of all tables, half of each cell's number, and sketches."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                for i in range(0, len(at), 1024):
                    part = batch.take(pa.array(at[i : i + 1024]))
                    unit = _unit(part.column(2).flatten().to_numpy().reshape(-1, n))
                    found, sketch = cells(unit).view(np.int64), sketches(unit)
                    ends = pa.array(np.arange(0, found.size + 1, found[0].size), pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (found.ravel(), (found.ravel() >> 32).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *lists, pa.array(np.ascontiguousarray(sketch[:, 0])), pa.array(np.ascontiguousarray(sketch[:, 1]))], names=["node", "times", "vec", "cells", "codes", "s1", "s2"])

    nodes = nodes.select("node", "times", "vec")
    return nodes.mapInArrow(run, f"node long, times long, vec {dict(nodes.dtypes)['vec']}, cells array<long>, codes array<int>, s1 long, s2 long")


def _whole_groups(batches) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows with the ends of their groups, of input sorted by the first two columns that name a group."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        g, cell = (t.column(i).to_numpy() for i in range(2))
        cut = np.flatnonzero((g[1:] != g[:-1]) | (cell[1:] != cell[:-1])) + 1
        if len(cut):
            yield t.slice(0, cut[-1]), np.concatenate([[0], cut])
            t = t.slice(cut[-1])
        held = t
    if held is not None:
        yield held, np.array([0, held.num_rows])


def possible(groups: DataFrame, cosine: float) -> DataFrame:
    """The rows (g, cell, slot, node, own, side, sides) that have a partner in their group by their sketches."""
    limit = sketch_limit(cosine)

    def some(ends: np.ndarray, node, own, side, sides, x) -> np.ndarray:
        out, square = np.zeros(len(node), bool), (x * x).sum(axis=1)
        of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))

        def meets(i, j):
            return (node[i] != node[j]) & (own[i] | own[j]) & (~sides[i] | (side[i] != side[j]))

        small = (np.diff(ends) <= SMALL)[of]
        i, d = np.flatnonzero(small), 1
        while len(i := i[i + d < len(of)]) and len(i := i[of[i] == of[i + d]]):
            for c in range(0, len(i), CHUNK):
                a = i[c : c + CHUNK]
                b = a + d
                ok = meets(a, b)
                a, b = a[ok], b[ok]
                near = ((x[a] - x[b]) ** 2).sum(axis=1) <= limit
                out[a[near]] = out[b[near]] = True
            d += 1
        for n in np.flatnonzero(np.diff(ends) > SMALL):
            at = np.arange(ends[n], ends[n + 1])
            near = square[at][:, None] + square[at][None, :] - 2 * (x[at] @ x[at].T) <= limit
            near &= meets(at[:, None], at[None, :])
            out[at] = near.any(axis=1)
        return out

    def run(batches):
        for t, ends in _whole_groups(batches):
            node, own, side, sides, s1, s2 = (t.column(c).to_numpy() for c in ("node", "own", "side", "sides", "s1", "s2"))
            x = np.stack([s1, s2], axis=1).view(np.int8).astype(np.float32)
            yield from t.drop_columns(["s1", "s2"]).filter(pa.array(some(ends, node, own, side, sides, x))).to_batches()

    return groups.mapInArrow(run, "g long, cell long, slot int, node long, own boolean, side int, sides boolean")


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links, in order, join two sets that weren't joined before."""
    parent = list(range(n))
    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            keep[i] = True
    return keep


def _counted(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Those pairs of rows that meet first in this table of theirs, and there in this cell as the least that they share.
    Most pairs meet in one of the first tables, so tables are gone through in order and few pairs are left for the later."""
    left, due = np.arange(len(i)), [np.zeros(0, np.int64)]
    for t in range(int(table.max(initial=-1)) + 1):
        here = table[left] == t
        due.append(left[here])
        left = left[~here]
        x, y = codes[i[left], t], codes[j[left], t]
        left = left[~((x[:, 0] == y[:, 0]) | (x[:, :1] == y[:, 1:]).any(1) | (y[:, :1] == x[:, 1:]).any(1))]
    due, home = np.sort(np.concatenate(due)), np.arange(1 + HALVES) == 0
    x, y = codes[i[due], table[due]], codes[j[due], table[due]]
    both = (x[:, :, None] == y[:, None, :]) & (home[:, None] | home[None, :])
    return due[np.where(both.any(2), x, np.iinfo(np.int32).max).min(1) == cell[due]]


def _lots(ends: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of groups that are compared at once: a large group alone, else groups of vectors of one length."""
    large = np.diff(ends) > SMALL
    lot, length = ends[:-1] // LOT, length[ends[:-1]]
    cut = (lot[1:] != lot[:-1]) | (length[1:] != length[:-1]) | large[1:] | large[:-1]
    bounds = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(large)]]).tolist()
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def _alike(u: np.ndarray, ends: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group, each once, with the cosine."""
    if len(ends) == 2:
        return np.nonzero(np.triu(u @ u.T >= cosine, 1))
    of, i, found = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), np.arange(len(u)), []
    for d in range(1, len(u)):
        i = i[i + d < len(of)]
        i = i[of[i] == of[i + d]]
        if not len(i):
            break
        found.append((i[np.einsum("ij,ij->i", u[i], u[i + d]) >= cosine], d))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([a + d for a, d in found])


def linked(groups: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): b null: n links of node a found in a group; else a link that joins a and b."""

    def run(batches):
        for t, ends in _whole_groups(batches):
            columns = [t.column(c).to_numpy() for c in ("node", "cell", "slot", "own", "side", "sides", "times")]
            vec, codes = (t.column(c).combine_chunks() for c in ("vec", "codes"))
            length = vec.value_lengths().to_numpy()
            for first, end in _lots(ends, length):
                at = slice(ends[first], ends[end])
                node, cell, slot, own, side, sides, times = (c[at] for c in columns)
                u = _unit(vec[at].flatten().to_numpy().reshape(len(node), -1))
                i, j = _alike(u, ends[first : end + 1] - ends[first], cosine)
                # of two blocks: pairs within one belong to that block's own group
                ok = (node[i] != node[j]) & (own[i] | own[j]) & (~sides[i] | (side[i] != side[j]))
                i, j = i[ok], j[ok]
                i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                c = codes[at].flatten().to_numpy().reshape(-1, TABLES, 1 + HALVES)
                parts = [slice(x, x + CHUNK) for x in range(0, len(i), CHUNK)]
                here = [p.start + _counted(c, i[p], j[p], slot[i[p]], cell[i[p]] >> 32) for p in parts]
                if not sum(map(len, here)):
                    continue
                here = np.concatenate(here)
                i, j = i[here], j[here]
                found = np.bincount(i, times[j], len(node)) + np.bincount(j, times[i], len(node))
                some = np.flatnonzero(found)
                keep = _joined(i, j, len(node))
                i, j = i[keep], j[keep]
                a, b = np.concatenate([node[some], node[i]]), np.concatenate([np.zeros(len(some), np.int64), node[j]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(a)) < len(some)), pa.array(np.concatenate([found[some].astype(np.int64), np.zeros(len(i), np.int64)]))], names=["a", "b", "n"])

    return groups.mapInArrow(run, "a long, b long, n long")


def neighbours(vectors: DataFrame, cosine: float = COSINE, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per row: key, n_links (other vectors linked directly), component_id, kept."""
    kept_type = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    vec = F.col(vector).cast("array<double>")
    sound = F.coalesce(F.col(key).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value; vectors that are null or broken are kept apart
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(sound, F.transform(vec, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(kept_type)).alias("vec"))
    rows = written(rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.hash("vec")), "vectors")
    several = rows.where("vec is not null").groupBy("id").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least < most").select("id", "least")
    if not several.isEmpty():
        whole, several = rows, written(several, "several")
        rows = whole.join(several, "id", "left").withColumn("vec", F.when(F.col("least").isNull() | (F.col("h1") == F.col("least")), F.col("vec")))
        rows = written(rows.select(whole.columns), "vectors")
        drop(whole, several)
    good = rows.where("vec is not null")
    classes = written(good.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("times"), F.min_by("vec", "id").alias("vec")), "classes")
    wide = written(placed(classes), "cells")
    # a cell's number tells its table and the vectors' length, and a node's cells of one table are different
    slot = F.posexplode("cells").alias("i", "cell")
    spots = wide.select("node", "s1", "s2", slot).select("cell", (F.col("i") / F.lit(1 + HALVES)).cast("int").alias("slot"), "node", (F.col("i") % F.lit(1 + HALVES) == 0).alias("own"), "s1", "s2")
    # cells in which two nodes stand, one of them at home
    busy = spots.groupBy("cell").agg(F.count("*").alias("k"), F.max("own").alias("home")).where("k > 1 and home").select("cell", "k")
    busy = written(busy, "busy")
    spots = spots.join(busy, "cell")
    # large cells: nodes are dealt to blocks by hash, and a group is made of every two blocks
    blocks = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
    spots = spots.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node", "slot"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least("mine", b).alias("low"), F.greatest("mine", b).alias("high"))))
    spots = spots.select("cell", "slot", "node", "own", "s1", "s2", "mine", pair.alias("p"))
    groups = spots.select(F.xxhash64("cell", "p.low", "p.high").alias("g"), "cell", "slot", "node", "own", F.col("mine").alias("side"), (F.col("p.low") != F.col("p.high")).alias("sides"), "s1", "s2")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = written(possible(groups.repartition(n, "g").sortWithinPartitions("g", "cell"), cosine), "possible")
    # half of each cell's number goes with the vector, to tell in which table a pair meets first
    groups = left.join(wide.select("node", "times", "vec", "codes"), "node").select(*left.columns, "times", "vec", "codes")
    found = written(linked(groups.repartition(n, "g").sortWithinPartitions("g", "cell"), cosine), "links")
    label = components(found.where("b is not null"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = classes.join(counts, "node", "left").join(label, "node", "left").select("h1", "h2", "node", "times", "n", "component")
    out = rows.join(named.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "node", "times", "n", "component"), F.col("vec").isNotNull() & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    links = F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long")
    component = F.coalesce("component", "node", "id")
    out = written(out.select(F.col("id").alias(key), links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")), "neighbours")
    drop(rows, classes, wide, busy, left, found, label)
    return out
