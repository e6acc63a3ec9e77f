"""Session settings for local runs, tests and the bench. A cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "pagequarry") -> SparkSession:
    cores_text = str(cores)
    shuffle = os.environ.get("PAGEQUARRY_SHUFFLE", "8" if cores_text == "*" else cores_text)
    spark = (
        SparkSession.builder.master(f"local[{cores_text}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Pages are large cells: few rows per Arrow batch keeps a Python worker's memory flat.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
