"""Stored form of product and card rows, and where it goes: CSV, JSON lines, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.schema import CARD_COLUMNS, MISSING, PRODUCT_COLUMNS
from pagequarry.sources.runs import append_run, committed, new_run


def _stored(rows: DataFrame, name: str) -> Column:
    if name not in rows.columns:
        return F.lit(MISSING).alias(name)
    if name == "index":
        return F.col(name)
    kind = rows.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, T.ArrayType):
        value = F.array_join(value, "; ")
    elif isinstance(kind, T.TimestampType):
        value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(value.cast("string"), F.lit(MISSING)).alias(name)


def stored_products(products: DataFrame) -> DataFrame:
    """The twelve stored columns; anything missing becomes N/A and list offers one text."""
    return products.select(*[_stored(products, c) for c in PRODUCT_COLUMNS])


def stored_cards(cards: DataFrame) -> DataFrame:
    """The ten stored card columns, missing texts empty."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in CARD_COLUMNS[:-1]]
    return cards.select(*texts, CARD_COLUMNS[-1])


def _counted(rows: DataFrame, save) -> int:
    """Run a write and return how many rows went into it."""
    seen = Observation()
    save(rows.observe(seen, F.count(F.lit(1)).alias("n")).write)
    return seen.get["n"]


def write_csv(rows: DataFrame, path: str) -> int:
    """A folder of CSV files with a header each; quotes are doubled, line breaks kept."""
    return _counted(
        rows, lambda w: w.option("header", True).option("escape", '"').mode("append").csv(path)
    )


def read_csv(spark, path: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    return reader.option("multiLine", True).csv(path)


def write_json(rows: DataFrame, path: str) -> int:
    """A folder of JSON-lines files, UTF-8, missing values left out unless already N/A."""
    return _counted(rows, lambda w: w.mode("append").json(path))


#: Columns of a stored product table.
STORED_SCHEMA = ", ".join(f"`{c}` {'int' if c == 'index' else 'string'}" for c in PRODUCT_COLUMNS)


def append_products(products: DataFrame, path: str, table_name: str = "scraped_products", run: str | None = None) -> DataFrame:
    """Append to a Parquet table by site; one row with the outcome. Nothing to save is an error
    record, not a failure. A run that is named may be repeated: it then replaces its own rows (see runs.py)."""
    count = append_run(stored_products(products), path, run or new_run(), ("site",))
    return _outcome(products.sparkSession, table_name, count)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed runs."""
    return committed(spark, path, STORED_SCHEMA).select(*PRODUCT_COLUMNS)


def append_products_jdbc(products: DataFrame, url: str, table_name: str, properties: dict[str, str]) -> DataFrame:
    """The same into a database table; each task inserts its own rows in batches."""
    count = _counted(stored_products(products), lambda w: w.mode("append").jdbc(url, table_name, properties=properties))
    return _outcome(products.sparkSession, table_name, count)


def _outcome(spark: SparkSession, table_name: str, count: int) -> DataFrame:
    ok = count > 0
    row = (
        ok,
        count,
        table_name,
        f"Successfully saved {count} products to {table_name}" if ok else None,
        None if ok else "No products to save",
    )
    schema = "success boolean, saved_count bigint, table_name string, message string, error string"
    return spark.createDataFrame([row], schema)


def export_json(report: DataFrame, path: str, by: str | None = "site", compression: str = "none") -> int:
    """Any report as JSON text, partitioned by site where it has one; nested values are kept. Files packed by gzip are read as text too."""
    body = F.to_json(F.struct(*report.columns)).alias("value")
    if by and by in report.columns:
        rows = report.select(F.col(by), body)
        return _counted(rows, lambda w: w.mode("append").option("compression", compression).partitionBy(by).text(path))
    return _counted(report.select(body), lambda w: w.mode("append").option("compression", compression).text(path))
