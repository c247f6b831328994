"""Gaussian peaks onto pixel grids: in long form, one row per pixel of a peak's window, or summed in dense tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import ieee_div, lit
from ..functions.special import erf


@dataclass(frozen=True)
class Axis:
    """n bin centres start, start + step, ...; ``window`` of them hold a peak."""

    name: str
    start: float
    step: float
    n: int
    window: int


def prepare_gaussian_bin(variance) -> Column:
    """Scale of the error function of one axis; correlations are ignored."""
    return ieee_div(1.0, F.sqrt(lit(variance)) * math.sqrt(2))


def bin_mass(centre, half, mean, scale) -> Column:
    """Mass of a Gaussian in one bin of one axis."""
    return 0.5 * (erf((lit(centre) + half - mean) * scale) - erf((lit(centre) - half - mean) * scale))


def sample_gaussian_bins(masses: list[Column]) -> Column:
    """Of independent axes: the product."""
    out = masses[0]
    for m in masses[1:]:
        out = out * m
    return out


def window_start(axis: Axis, mean: Column) -> Column:
    """First index of the window: nearest centre (the lower of two) less half the window, held inside the axis."""
    nearest = F.greatest(F.lit(0), F.least(F.lit(axis.n - 1), F.ceil((mean - axis.start) / axis.step - 0.5).cast("int")))
    return F.greatest(F.lit(0), F.least(F.lit(axis.n - axis.window), nearest - axis.window // 2))


def _edges(a: Axis) -> Column:
    """Error function at the window's bin edges: neighbours share them, so window + 1 values serve."""
    mean, scale, first = F.col(a.name), F.col(f"_s_{a.name}"), F.col(f"_f_{a.name}")
    at = F.transform(F.sequence(F.lit(0), F.lit(a.window)), lambda i: (a.start + (first + i) * a.step - a.step / 2 - mean) * scale)
    return F.transform(at, erf)  # of a bare variable: the approximation names its argument a hundred times


def _masses(a: Axis) -> Column:
    edges, first = F.col(f"_e_{a.name}"), F.col(f"_f_{a.name}")
    return F.transform(F.sequence(F.lit(0), F.lit(a.window - 1)), lambda i: F.struct((first + i).alias("i"), (0.5 * (F.get(edges, i + 1) - F.get(edges, i))).alias("p")))


def _marginals(peaks: DataFrame, axes: list[Axis], amplitude: str | None) -> tuple[DataFrame, list[str]]:
    """The key columns left over, ``_amp``, and for each axis ``_m_<axis>``, its window's bins with their masses."""
    used = [c for a in axes for c in (a.name, f"var_{a.name}")] + ([amplitude] if amplitude else [])
    rest = [c for c in peaks.columns if c not in used]
    df = peaks
    for a in axes:
        scaled, first = prepare_gaussian_bin(F.col(f"var_{a.name}")), window_start(a, F.col(a.name))
        df = df.withColumns({f"_s_{a.name}": scaled, f"_f_{a.name}": first})
    for a in axes:
        df = df.withColumn(f"_e_{a.name}", _edges(a))
    for a in axes:
        df = df.withColumn(f"_m_{a.name}", _masses(a))
    return df.select(*rest, *([F.col(amplitude).cast("double").alias("_amp")] if amplitude else [F.lit(1.0).alias("_amp")]), *(f"_m_{a.name}" for a in axes)), rest


def peaks_to_pixels(peaks: DataFrame, axes: list[Axis], amplitude: str | None = None) -> DataFrame:
    """``peaks`` (mean and variance of axis ``sc`` in columns ``sc`` and ``var_sc``, and so on) to one row per pixel of
    the window: the key columns left over, i_<axis>, intensity.

    Masses are worked out for each axis alone, and only then the product is taken: the error function is called for
    the sum of the windows' lengths, not for their product.
    """
    df, rest = _marginals(peaks, axes, amplitude)
    for a in axes:
        df = df.withColumn(f"_p_{a.name}", F.explode(f"_m_{a.name}")).drop(f"_m_{a.name}")
    product = sample_gaussian_bins([F.col("_amp"), *(F.col(f"_p_{a.name}.p") for a in axes)])
    return df.select(*rest, *(F.col(f"_p_{a.name}.i").alias(f"i_{a.name}") for a in axes), product.alias("intensity"))


peak_to_pixels = peaks_to_pixels


def image(pixels: DataFrame, axes: list[Axis]) -> DataFrame:
    """Sum of all peaks at each pixel, combined map-side first."""
    return pixels.groupBy(*(f"i_{a.name}" for a in axes)).agg(F.sum("intensity").alias("intensity"))


#: Bins of a tile along the first two axes and along further ones, and tiles that a task holds at once.
TILE, FURTHER, HELD = 16, 8, 2048


def _added(tiles: dict[int, np.ndarray], at: np.ndarray, offset: np.ndarray, values: np.ndarray, size: int) -> None:
    """Add to dense tiles; what no value was added to stays NaN."""
    known, place = np.unique(at, return_inverse=True)
    flat = place * size + offset
    sums = np.bincount(flat, values, len(known) * size).reshape(len(known), size)
    touched = np.bincount(flat, minlength=len(known) * size).reshape(len(known), size) > 0
    for k, t in enumerate(known.tolist()):
        held = tiles.setdefault(t, np.full(size, np.nan))
        held[touched[k]] = np.nan_to_num(held[touched[k]]) + sums[k][touched[k]]


def _layout(axes: list[Axis], tile: int, further: int) -> tuple[list[int], list[int]]:
    """Bins of a tile and tiles of the grid, along each axis."""
    shape = [min(a.n, tile if k < 2 else further) for k, a in enumerate(axes)]
    return shape, [-(-a.n // t) for a, t in zip(axes, shape, strict=True)]


def partial_tiles(peaks: DataFrame, axes: list[Axis], amplitude: str | None = None, frame: str | None = None, tile: int = TILE, further: int = FURTHER) -> DataFrame:
    """(tile, pixels): dense tiles of what each task has seen, NaN where no window was. Tiles are numbered row by row, and on from one
    ``frame`` (a whole number, such as that of a time window) to the next. Peaks with a null or NaN mean or variance have no window."""
    known = " and ".join(f"{c} is not null and not isnan({c})" for a in axes for c in (a.name, f"var_{a.name}"))
    df, _ = _marginals(peaks.where(known), axes, amplitude)
    shape, grid = _layout(axes, tile, further)
    size = math.prod(shape)
    number = F.col(frame).cast("long") if frame else F.lit(0).cast("long")
    columns = [F.col("_amp"), number.alias("frame")] + [F.col(f"_m_{a.name}.i").getItem(0).alias(f"f_{a.name}") for a in axes] + [F.col(f"_m_{a.name}.p").alias(f"p_{a.name}") for a in axes]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[int, np.ndarray] = {}
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                n, k = part.num_rows, len(axes)
                at, offset, value = part.column(1).to_numpy()[:, None], np.zeros((n, 1), np.int64), part.column(0).to_numpy()[:, None]
                for i, a in enumerate(axes):
                    bins = part.column(2 + i).to_numpy()[:, None].astype(np.int64) + np.arange(a.window)
                    mass = part.column(2 + k + i).flatten().to_numpy().reshape(n, a.window)
                    at = (at[:, :, None] * grid[i] + (bins // shape[i])[:, None, :]).reshape(n, -1)
                    offset = (offset[:, :, None] * shape[i] + (bins % shape[i])[:, None, :]).reshape(n, -1)
                    value = (value[:, :, None] * mass[:, None, :]).reshape(n, -1)
                _added(tiles, at.ravel(), offset.ravel(), value.ravel(), size)
                if len(tiles) > HELD:
                    yield _batch(tiles, size)
        yield _batch(tiles, size)

    return df.select(*columns).mapInArrow(spread, "tile long, pixels array<double>")


def _batch(tiles: dict[int, np.ndarray], size: int) -> pa.RecordBatch:
    """All tiles as rows; they are let go of."""
    n, values = np.arange(len(tiles) + 1, dtype=np.int32) * size, np.concatenate([np.zeros(0), *tiles.values()])
    out = pa.RecordBatch.from_arrays([pa.array(list(tiles), pa.int64()), pa.ListArray.from_arrays(pa.array(n), pa.array(values))], names=["tile", "pixels"])
    tiles.clear()
    return out


def added_tiles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two tiles; NaN where neither had a window."""
    return np.where(np.isnan(a), b, a + np.nan_to_num(b))


def tile_pixels(tiles: DataFrame, axes: list[Axis], tile: int = TILE, further: int = FURTHER, frame: str | None = None) -> DataFrame:
    """Whole tiles as rows of pixels: i_<axis>, intensity, and the frame's number where one is named."""
    shape, grid = _layout(axes, tile, further)
    pixels = tiles.select("tile", F.posexplode("pixels").alias("offset", "intensity")).where("intensity is not null and not isnan(intensity)")
    index, rest, within = {}, F.col("tile"), F.col("offset").cast("long")
    for a, t, g in reversed(list(zip(axes, shape, grid, strict=True))):
        index[f"i_{a.name}"] = (F.pmod(rest, F.lit(g)) * t + within % t).cast("int")
        rest, within = F.floor(rest / g), F.floor(within / t)
    return pixels.select(*([rest.alias(frame)] if frame else []), *(index[f"i_{a.name}"].alias(f"i_{a.name}") for a in axes), "intensity")


def image_of_peaks(peaks: DataFrame, axes: list[Axis], amplitude: str | None = None, tile: int = TILE, further: int = FURTHER) -> DataFrame:
    """i_<axis>, intensity: the sum of all peaks at each pixel that a window covers, as :func:`image` of :func:`peaks_to_pixels`, for any
    number of axes (slow, fast, omega, and dty of a scan).

    Peaks are added to dense tiles within tasks, so what is shuffled is a row for each tile that a task has seen, however many peaks it
    holds: tiles of equal number are added up, and only the sum is taken apart into pixels. A crowded tile costs a row a task. Tasks
    hold ``HELD`` tiles at once and pass on what they have beyond that.
    """
    size = math.prod(_layout(axes, tile, further)[0])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            pixels = b.column(1).flatten().to_numpy().reshape(-1, size)
            for t, own in zip(b.column(0).to_pylist(), pixels, strict=True):
                if t not in held and held:  # rows are in the order of tiles: the one before is complete
                    yield _batch(held, size)
                held[t] = added_tiles(held[t], own) if t in held else own.copy()
        yield _batch(held, size)

    partial = partial_tiles(peaks, axes, amplitude, None, tile, further)
    tiles = partial.repartition(F.col("tile")).sortWithinPartitions("tile").mapInArrow(summed, "tile long, pixels array<double>")
    return tile_pixels(tiles, axes, tile, further)
