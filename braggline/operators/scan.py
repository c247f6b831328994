"""Scan grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step_grid_from_ybincens(ybins: DataFrame, step_size: float, gridstep: int, y0: float, y: str = "y") -> DataFrame:
    """(si, sj) of the square grid -N, -N + gridstep, ... up to N, N = ceil(max |y - y0| / step_size). No rows without bins."""
    n = ybins.agg(F.ceil(F.max(F.abs(F.col(y) - F.lit(float(y0)))) / F.lit(float(step_size))).cast("int").alias("n")).where("n is not null")
    steps = lambda: F.explode(F.sequence(-F.col("n"), F.col("n"), F.lit(int(gridstep))))
    return n.withColumn("si", steps()).withColumn("sj", steps()).select("si", "sj")
