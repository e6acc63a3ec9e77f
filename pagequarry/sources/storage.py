"""Shared folders and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a local one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="pagequarry-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(rows: DataFrame, purpose: str = "cut", by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write rows to a table in the shared folder and read them back: later uses neither recompute
    them nor depend on the executors that wrote them. `by` gives each value of these columns a folder; `options` are the writer's."""
    path = new_folder(rows.sparkSession, purpose)
    rows.write.options(**options).partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
