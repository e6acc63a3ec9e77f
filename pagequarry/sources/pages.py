"""Page tables: landed crawl output and html files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.text import strip


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Scan a table of long texts. A scan of fewer splits than cores is spread, since the work on a
    text far outweighs moving it; a large one has splits enough and is left alone."""
    rows = spark.read.parquet(path)
    rows = rows.select(*columns) if columns else rows
    cores = spark.sparkContext.defaultParallelism
    # A bare file scan: asking for its partitions plans it but runs nothing.
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "page_id", "url", "html")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per html file, keyed by its path, with undecodable UTF-8 bytes dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    raw = F.col("content").cast("string")
    # A file that decodes cleanly is taken as it is, so a U+FFFD it really holds survives.
    text = F.coalesce(
        F.try_validate_utf8(raw), F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))
    )
    return files.select(F.col("path").alias("page_id"), F.col("path").alias("url"), text.alias("html"))


def unread_pages(parsed: DataFrame) -> DataFrame:
    """(page_id, reason) of the pages of a `parse_pages` result that could not be read, with the whole error."""
    return parsed.filter("parse_error is not null").select("page_id", F.col("parse_error").alias("reason"))


def split_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with content, and the others as (page_id, reason)."""
    empty = strip(F.coalesce(F.col("html"), F.lit(""))) == ""
    return pages.filter(~empty), pages.filter(empty).select(
        "page_id", F.lit("no html content").alias("reason")
    )
