"""One thin query per training-data operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, lattice_neighbours, license_scan, minhash_dedup, packing, passages, prefix_tokens, quality, repeated_windows, secret_scan, spelling_variants, toxicity
from .sample import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repository() -> Column:
    """The documents' sources stand for owners, a source's languages for its repositories."""
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), F.col("source"), repository())
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage twice: from the side of the later document and from that of the earlier one. Of all pairs of different texts, not of the first holders alone."""
    found = passages.repeats(table(spark, sf_dir, "documents"), whole=True)
    names = ("doc_id", "first_word", "n_words")
    side = lambda a, b: F.struct(*(F.col(f"{a}{n}").alias(n) for n in names), *(F.col(f"{b}{n}").alias(f"other_{n}") for n in names), "n_equal", "identity")
    return found.select(F.explode(F.array(side("", "other_"), side("other_", ""))).alias("x")).select("x.*")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_lattice_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.scored(docs, model, fold("doc_id", 5) == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model | None:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity_model(docs, spark, sf_dir), fold("doc_id", 4) == 2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows.digest(repeated_windows.without_repeats(table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_passages, op3_license_scan, op4_lattice_neighbours, op5_minhash_dedup, op6_quality, op7_token_counts, op8_toxicity, op9_packing, op10_decontaminate, op11_spelling_variants, op12_repeated_windows, op13_collocations)}
_COMPONENTS = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT {key}, {key} FROM {table} UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)"""

#: All pairs that share a shingle, exactly; for small tables.
_OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM s JOIN s AS t ON s.sh = t.sh AND s.doc_id < t.doc_id GROUP BY s.doc_id, t.doc_id),
l AS (SELECT a, b FROM p JOIN n AS m ON m.doc_id = a JOIN n AS o ON o.doc_id = b WHERE 100 * c >= 75 * (m.n + o.n - c)),
{_COMPONENTS.format(key="doc_id", table="documents")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id"""

#: The cosine of every pair, in double precision; for small tables.
_OP4 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT s.vec_id AS a, t.vec_id AS b FROM v AS s JOIN v AS t ON s.vec_id < t.vec_id WHERE list_cosine_similarity(s.v, t.v) BETWEEN 0.95 AND 2),
{_COMPONENTS.format(key="vec_id", table="embeddings")},
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT d.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, d.vec_id = c.component_id AS kept FROM embeddings AS d LEFT JOIN k ON k.a = d.vec_id LEFT JOIN c ON c.x = d.vec_id"""

ORACLE: dict[str, str] = {"op1_secret_scan": secret_scan.oracle(), "op4_lattice_neighbours": _OP4, "op5_minhash_dedup": _OP5}
