"""Bounded, repeatable samples of labelled rows, and small numpy fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(of))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, longest: int, text: str = "text", key: str = "doc_id") -> tuple[list[str], list[str], float]:
    """Texts with label 1 and with label 0, at most ``most`` each, of those up to ``longest`` characters, of the first
    2 * ``most`` keys in the order of a hash; texts that occur twice count once. Null texts and labels are left out. The
    third value is the share of label 1 among all labels that may be learnt from."""
    known = labels.where(learn).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    n, ones = known.agg(F.count("y"), F.sum("y")).first()
    # keys first: 2 * most of each label at most, so that texts are found by a broadcast of bounded size and never shuffled
    keys = [(r.k, y) for y in (1, 0) for r in known.where(F.col("y") == y).select("k", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(2 * most).collect()]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(keys, f"k {known.schema['k'].dataType.simpleString()}, y int"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= longest)).join(chosen, "k")
    got = sorted(rows.select("k", "y", "t", F.xxhash64("k").alias("h")).collect(), key=lambda r: (r.h, r.k, r.t))
    out = [list(dict.fromkeys(r.t for r in got if r.y == y))[:most] for y in (1, 0)]
    return out[0], out[1], (ones or 0) / max(1, n)


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Row weights that give label 1 the wanted share."""
    mean = y.mean()
    return np.where(y == 1, share / mean, (1 - share) / (1 - mean))


def logistic(x: np.ndarray, y: np.ndarray, row_weights: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (row_weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (row_weights * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w
