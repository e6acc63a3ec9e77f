"""Tables that runs append to: a run's rows are seen as a whole or not at all, and a run done again replaces its own rows.

A run stages its rows in a folder of its own attempt. What makes them visible is one line in the table's list of commits, written
after the rows. Readers take, of each run, the attempt of its last commit; rows of attempts that failed or were replaced are never
read. The list has a line for each commit, not for each row, and the reader's join prunes the scan to the folders it names.

    path/data/run=run-<id>/attempt=a<number>/...
    path/commits/run=run-<id>/<json line: number, attempt, rows>
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMMITS = "run string, number long, attempt string, rows long"


def new_run() -> str:
    return uuid.uuid4().hex


def stage(rows: DataFrame, path: str, run: str, by: tuple[str, ...] = ()) -> tuple[str, int]:
    """Write rows where no reader looks; the attempt's name and how many rows went into it."""
    attempt, seen = f"a{uuid.uuid4().hex}", Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.partitionBy(*by).parquet(f"{path}/data/run=run-{run}/attempt={attempt}")
    return attempt, seen.get["n"]


def commit(spark: SparkSession, path: str, run: str, attempt: str, rows: int) -> None:
    """Make an attempt the one that stands for its run. The line is appended, so a failing commit leaves the one before."""
    folder = f"{path}/commits/run=run-{run}"
    number = F.unix_micros(F.current_timestamp()).alias("number")
    line = spark.range(1).select(number, F.lit(attempt).alias("attempt"), F.lit(rows).cast("long").alias("rows"))
    line.coalesce(1).write.mode("append").json(folder)


def append_run(rows: DataFrame, path: str, run: str, by: tuple[str, ...] = ()) -> int:
    """Stage and commit; how many rows the run has now."""
    attempt, count = stage(rows, path, run, by)
    commit(rows.sparkSession, path, run, attempt, count)
    return count


def commits(spark: SparkSession, path: str) -> DataFrame:
    """run, attempt and rows of the last commit of every run."""
    lines = spark.read.schema(COMMITS).json(f"{path}/commits")
    last = F.max_by(F.struct("attempt", "rows"), F.struct("number", "attempt")).alias("c")
    return lines.groupBy("run").agg(last).select("run", "c.attempt", "c.rows")


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last commit of every run. `schema` is that of the rows."""
    rows = spark.read.schema(f"{schema}, run string, attempt string").parquet(f"{path}/data")
    # A run without rows has no folder to read; the condition also lets Spark prune the scan by what the join finds.
    named = commits(spark, path).where(F.col("rows") > 0).select("run", "attempt")
    return rows.join(named, ["run", "attempt"], "left_semi").drop("run", "attempt")
