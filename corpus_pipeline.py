"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written
as Parquet and read again as the next one's docs. All but the last return the columns they were given.

Defined results: rows with a null or empty text fall to the quality rules; repeated rows count as copies of
one another; columns beyond those of documents are carried along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, decontaminate, near_dedup, quality_rules, secret_scan
from pagequarry.sources.storage import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ratios = quality_rules.log_ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, ratios)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the smallest id, and one row of it."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = cut(leaks.select(F.col("doc_id").alias("leak_id"), F.col("key").alias("leak_key")).distinct(), "leaks")
    same = docs["doc_id"].eqNullSafe(F.col("leak_id")) & (decontaminate.text_key(docs["text"]) == F.col("leak_key"))
    return docs.join(leaks, same, "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced in the texts; n_chars follows the text."""
    done = secret_scan.redact(docs, secret_scan.trained(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the token ids and of the text decoded from them."""
    rows = bpe.round_trip(docs)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("tokens", tokens),
]
#: The forest, the network of links and the tokenizer can't be said in SQL; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
