"""Peaks to scattering vectors on a stream, and a windowed powder histogram."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forward import Setup
from ..operators.peaks import peaks_to_q


def stream_peaks_to_q(peaks: DataFrame, setup: Setup) -> DataFrame:
    """Stateless: the batch operator as it is."""
    return peaks_to_q(peaks, setup)


def stream_powder_histogram(peaks: DataFrame, setup: Setup, time: str, window: str, late: str, width: float = 0.1) -> DataFrame:
    """(window, bin, n): peaks by time window and 2 theta bin; rows later than ``late`` are left out."""
    q = peaks_to_q(peaks.withWatermark(time, late), setup)
    return q.groupBy(F.window(time, window).alias("window"), F.floor(F.col("tth") / width).alias("bin")).agg(F.count("*").alias("n"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of ``spark.checkpoint.dir``, removed when the driver ends; a folder of our own serves local runs alone."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/braggline-streams"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def finished(spark: SparkSession, stream: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """A stream of what is there now, run to its end into files and read back; they and the stream's checkpoint stand in one shared
    folder. ``settings`` hold in the session while it starts."""
    path = shared_path(spark, name)
    was = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        run = stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return
