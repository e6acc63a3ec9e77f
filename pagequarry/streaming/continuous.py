"""The same extraction over pages as they land."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.functions.text import has_value
from pagequarry.operators.extract import Config, extract_products
from pagequarry.operators.quality import percent
from pagequarry.plans.workflow import THRESHOLD, gate
from pagequarry.schema import FIELDS
from pagequarry.sources.storage import cut

PAGE_SCHEMA = "page_id bigint, url string, html string, site string, scraped_at timestamp"


def landed_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def first_copies(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Pages whose address and content were not seen within the watermark."""
    marked = pages.withWatermark("scraped_at", late).withColumn("content", F.sha2("html", 256))
    return marked.dropDuplicatesWithinWatermark(["url", "content"]).drop("content")


def extract_stream(
    pages: DataFrame,
    configs: Mapping[str, Config],
    table_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Extract every micro-batch and store it under its own folder: a batch that runs twice replaces
    itself. `gated_products` judges what is stored."""

    def store(batch: DataFrame, number: int) -> None:
        extract_products(batch, configs).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return (
        pages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def gated_products(spark: SparkSession, table_path: str, threshold: float = THRESHOLD) -> DataFrame:
    """The stored rows of all batches, marked by the rate of their site over all of them: the marks do
    not depend on how the pages were dealt into batches."""
    return gate(spark.read.parquet(table_path).drop("batch"), threshold)


def window_counts(products: DataFrame, span: str) -> DataFrame:
    """window_start, window_end, site, total and the number of values of every field."""
    return (
        products.groupBy(F.window("scraped_at", span).alias("w"), "site")
        .agg(F.count(F.lit(1)).alias("total"), *[F.count_if(has_value(F.col(f))).alias(f) for f in FIELDS])
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "site", "total", *FIELDS)
    )


def field_rates(counts: DataFrame) -> DataFrame:
    """One row per window, site and field with its success rate."""
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("valid")) for f in FIELDS])
    rows = counts.select("window_start", "site", "total", F.inline(named))
    return rows.withColumn("success_rate", percent(F.col("valid"), F.col("total")))


def rates_over_time(products: DataFrame, span: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Field success rates per time window and site; works on streams and tables."""
    return field_rates(window_counts(products.withWatermark("scraped_at", late), span))


def rates_stream(
    products: DataFrame, folder: str, checkpoint: str, span: str = "1 hour", late: str = "1 day"
) -> StreamingQuery:
    """Rates per window, each window written once, when it can no longer change.

    Batch n reads the open windows and the mark (the latest time seen) that batch n - 1 left, and writes its own folders of closed
    and open windows, of late rows and of the mark; a batch that runs twice replaces what it wrote. A window closes when
    the mark is `late` past its end. Rows of closed windows are kept aside, none is lost. What is carried on
    are the open windows of each site, a row each, so it shrinks as windows close.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, mark = cut(batch, "batch"), None
        if number:
            mark = spark.read.parquet(f"{folder}/marks/batch={number - 1}").first().mark
        limit = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {late}")
        closed = F.coalesce(F.window("scraped_at", span)["end"] <= limit, F.lit(False)) if mark else F.lit(False)
        marked = rows.withColumn("is_late", closed)
        marked.filter("is_late").drop("is_late").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        counts = window_counts(marked.filter("not is_late"), span)
        if number:
            before = spark.read.parquet(f"{folder}/windows/batch={number - 1}").filter("not closed").drop("closed")
            counts = counts.unionByName(before)
        counts = counts.groupBy("window_start", "window_end", "site").agg(*[F.sum(c).alias(c) for c in ("total", *FIELDS)])
        latest = rows.agg(F.max("scraped_at").alias("m")).select(F.greatest("m", F.lit(mark).cast("timestamp")).alias("mark"))
        latest = cut(latest, "mark")
        until = F.lit(latest.first().mark).cast("timestamp") - F.expr(f"INTERVAL {late}")
        counts = counts.withColumn("closed", F.coalesce(F.col("window_end") <= until, F.lit(False)))
        counts.write.mode("overwrite").parquet(f"{folder}/windows/batch={number}")
        latest.write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    return (
        products.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the windows that are done, each written by one batch."""
    return spark.read.parquet(f"{folder}/windows").filter("closed").drop("closed", "batch")


def open_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts so far of the windows that may still change: those of the last batch."""
    rows = spark.read.parquet(f"{folder}/windows")
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(last, F.col("batch") == F.col("last")).filter("not closed").drop("closed", "batch", "last")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that came after their window was closed, with the batch they came in."""
    return spark.read.parquet(f"{folder}/late")


def visits(pages: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Landings of one address that follow each other within the gap, as one visit each: first and last time, landings, and whether
    the content changed in between. Works on tables and, behind a watermark, on streams."""
    content = F.struct("scraped_at", F.sha2("html", 256).alias("h"))
    return (
        pages.groupBy("url", F.session_window("scraped_at", gap).alias("s"))
        .agg(
            F.count(F.lit(1)).alias("landings"),
            F.max("scraped_at").alias("last_seen"),
            F.min(content)["h"].alias("first_content"),
            F.max(content)["h"].alias("last_content"),
        )
        .select(
            "url",
            F.col("s.start").alias("first_seen"),
            "last_seen",
            "landings",
            (F.col("first_content") != F.col("last_content")).alias("changed"),
        )
    )
