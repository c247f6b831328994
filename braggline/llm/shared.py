"""Tables in the folder that driver and executors share, and distributed connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written by this driver, removed with their folder when it ends; callers drop them earlier where they can.
_WRITTEN: list[tuple[SparkSession, str]] = []
#: Spark's own setting that removes a query's shuffle files when it ends, and not when its plan is collected as garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``. Where that is unset, a folder of our own serves
    local runs (tests) alone: on a cluster, executors don't share the driver's disk, and that is an error."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/braggline-shared"
    return f"{base.rstrip('/')}/braggline-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends at that table, so a
    lost executor costs a reread of files and not a recomputation. The job's shuffle files go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, t._shared_path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    folders = {path.rsplit("/", 1)[0]: spark for spark, path in _WRITTEN}
    for path, spark in folders.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component), a written table: the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star steps on the edge list, each an aggregate and a join of written tables, whose
    plain exchanges skew handling can split; edges are never gathered in one task or on the driver. Nulls and loops
    are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v").distinct()
    e = written(e, "edges")
    mark = None
    while True:
        n, s = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, s) == mark:
            break
        mark = (n, s)
        # large star: every larger neighbour of a node links to the least of the node and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), "least")
        large = both.join(least, both["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "large")
        drop(e, least)
        # small star: a node and its smaller neighbours link to the least of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"), "least")
        small = large.join(least, large["u"] == least["c"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v").distinct()
        e = written(small, "edges")
        drop(large, least)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = written(out, "components")
    drop(e)
    return out
