"""Images of peaks on a stream: one image a time window, its tiles kept as state until the window is over."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import splat

#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TileState(StatefulProcessor):
    """A tile's sum so far. A timer at the end of the tile's window passes the sum on and lets go of it."""

    def __init__(self, tiles: int, seconds: int):
        self.tiles, self.seconds = tiles, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sum = handle, handle.getValueState("sum", "pixels array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        total = np.array(self.sum.get()[0], float) if self.sum.exists() else None
        if total is None:
            self.handle.registerTimer(int((key[0] // self.tiles + 1) * self.seconds * 1000 - 1))
        for df in rows:
            for own in df["pixels"]:
                own = np.array(own, float)  # what no window covers may come as null
                total = own if total is None else splat.added_tiles(total, own)
        self.sum.update(([float(x) for x in total],))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pixels = self.sum.get()[0]
        self.sum.clear()
        yield pd.DataFrame({"tile": [key[0]], "pixels": [list(pixels)]})

    def close(self) -> None:
        pass


def stream_image(peaks: DataFrame, axes: list[splat.Axis], time: str, seconds: int, late: str, amplitude: str | None = None) -> DataFrame:
    """(window, i_<axis>, intensity): the image of each time window of so many seconds (numbered from 1970 on), given once the watermark, the
    end of the latest window seen less ``late``, is past its end. Peaks of windows that are over are left out.

    Each batch is summed to tiles first; state holds one tile for each window that is open, wherever peaks have been, and is kept by
    Spark's state store and checkpoint, so that a stream goes on where it was stopped. Set :data:`STORE` in the session before it starts.
    """
    numbered = peaks.withColumn("_window", F.floor(F.unix_micros(F.col(time)) / (seconds * 1_000_000)))
    tiles = math.prod(splat._layout(axes, splat.TILE, splat.FURTHER)[1])
    parts = splat.partial_tiles(numbered, axes, amplitude, "_window")
    parts = parts.withColumn("at", F.timestamp_millis((F.floor(F.col("tile") / tiles) + 1) * (seconds * 1000) - 1)).withWatermark("at", late)
    whole = parts.groupBy("tile").transformWithStateInPandas(statefulProcessor=TileState(tiles, seconds), outputStructType="tile long, pixels array<double>", outputMode="Append", timeMode="EventTime")
    return splat.tile_pixels(whole, axes, frame="window")
