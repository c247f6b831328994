"""Images on a stream against the batch image: several batches, a restart, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from braggline.operators import splat
from braggline.streaming.images import STORE, stream_image

AXES = [splat.Axis("sc", 0, 1, 40, 5), splat.Axis("fc", 0, 1, 20, 3)]
SCHEMA = "id long, t timestamp, sc double, fc double, var_sc double, var_fc double"
BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def rows(spark, first, n, hours):
    """Peaks spread over so many hours from the first one on."""
    k = F.col("id")
    df = spark.range(first, first + n).select(k, F.timestamp_seconds(F.lit(int(BEGIN.timestamp())) + (k - first) * (hours * 3600) / n).alias("t"), (k * 37 % 400 / 10.3).alias("sc"), (k * 11 % 200 / 10.7).alias("fc"))
    return df.withColumn("var_sc", F.lit(0.6)).withColumn("var_fc", F.lit(0.4))


def test_stream_image(spark, tmp_path):
    was = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        source, out = str(tmp_path / "in"), str(tmp_path / "out")
        whole = [rows(spark, 0, 120, 3), rows(spark, 1000, 90, 5)]
        late = rows(spark, 5000, 10, 1)  # of the first hour, when it is long over
        beyond = rows(spark, 9000, 3, 0).withColumn("t", F.col("t") + F.expr("INTERVAL 30 HOURS"))

        def run():
            peaks = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            q = stream_image(peaks, AXES, "t", 3600, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(200)
            assert q.exception() is None

        for k, part in enumerate([*whole, beyond, late]):
            part.coalesce(1).write.mode("append").parquet(source)
            if k != 0:  # two batches at once, then a start from the checkpoint for each
                run()
        got = {(r.window, r.i_sc, r.i_fc): r.intensity for r in spark.read.parquet(out).collect()}
        both = whole[0].unionByName(whole[1]).withColumn("window", F.floor(F.unix_micros("t") / 3_600_000_000))
        want = {}
        for r in splat.peaks_to_pixels(both.drop("id", "t"), AXES).groupBy("window", "i_sc", "i_fc").agg(F.sum("intensity").alias("x")).collect():
            want[r.window, r.i_sc, r.i_fc] = r.x
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)
        assert len({x[0] for x in got}) == 5
    finally:
        spark.conf.unset(STORE[0]) if was is None else spark.conf.set(STORE[0], was)
