"""Documents to training sequences: five stages, each written as Parquet and read again as the next one's documents.

Toxicity drops documents that its classifier rejects; MinHash near-dedup keeps one document of each group;
benchmark decontamination drops documents that hold a benchmark item; the secret scan replaces secrets in the
texts; packing returns the pieces of the packed sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braggline.llm import decontaminate, minhash_dedup, packing, secret_scan, toxicity
from braggline.llm.queries import repository, table, toxicity_model
from braggline.llm.shared import drop, written

#: Bytes that are handed to a Python worker at once. By Spark's default, 64 MB, a batch of 10,000 whole texts stands in
#: buffers beside the JVM's heap and again in the worker, with what it returns.
BATCH = 4 << 20


def in_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with batches of ``BATCH`` bytes. Its result is made when it is written, so the session keeps the setting."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table hasn't."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


@in_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled rows among the stage's own documents."""
    return toxicity.accepted(docs, toxicity_model(docs, spark, sf_dir))


@in_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group stays, once. Documents without an id link with nothing and stay. Of
    several texts under one id, all but one take a number beyond all ids, so that each is a document of its own."""
    known, row, th, least = docs.where("doc_id is not null"), fresh(docs, "_row"), fresh(docs, "_th"), fresh(docs, "_least")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    several = known.groupBy("doc_id").agg(F.min(hashed).alias(least), F.max(hashed).alias(th)).where(F.col(least) < F.col(th))
    several = written(several.select("doc_id", least), "several")
    if several.isEmpty():
        known = known.withColumn(row, F.col("doc_id"))
    else:
        known = known.join(several, "doc_id", "left").withColumn(th, hashed)
        beyond = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", th), F.lit(1 << 62))
        known = known.withColumn(row, F.when(F.col(th) > F.col(least), beyond).otherwise(F.col("doc_id"))).drop(th, least)
    kept = minhash_dedup.near_duplicates(known.select(row, "text"), key=row).where("kept").select(row).distinct()
    once = known.join(kept, row, "left_semi").dropDuplicates([row])
    return once.select(docs.columns).unionByName(docs.where("doc_id is null"))


@in_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@in_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text where a secret was masked."""
    was = fresh(docs, "_was")
    out = secret_scan.redact(docs, F.col("source"), repository(), was=was)
    return out.withColumn("n_chars", F.when(F.col(was), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


@in_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("8 toxicity", drop_toxic),
    ("5 minhash near-dedup", drop_near_duplicates),
    ("10 benchmark decontamination", drop_benchmark),
    ("1 secret scan", mask_secrets),
    ("9 packing", pack_sequences),
]

#: Compression lengths and byte-pair tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one by one. A stage's table goes when the next one is written; the last is read by the result, and goes with the driver."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
            if before is not None:
                drop(before)
            before = docs
    return docs
