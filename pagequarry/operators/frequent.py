"""The most frequent values of a very large table, exactly, without shuffling every different value.

1. Each task keeps a summary of at most `size` counters (mergeable frequent-item summary: when there are more, the count
   of the first one beyond is taken off all of them, and added to what the task may have missed).
2. Only values that stand in some summary are counted exactly, with their first place.
3. A value in no summary occurs at most as often as all tasks together may have missed. If the last value reported occurs
   more often than that, the list is proven; else the summaries are made larger, up to whole tables of a task's values.

So `size` times the number of tasks bounds the rows that are shuffled in a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.sources.storage import cut

SIZE = 1000


def summaries(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Of rows (keys, n): the counters of each task and, in a row of its own without keys, what it may have missed."""
    schema = ", ".join([f"{k} string" for k in keys] + ["n long", "missed long"])

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, missed = None, 0
        for batch in batches:
            table = pa.table({c: batch.column(c) for c in (*keys, "n")})
            if held is not None:
                table = pa.concat_tables([held, table])
            held = table.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])
            if held.num_rows > size:
                held = held.sort_by([("n", "descending")])
                cutoff = held["n"][size].as_py()
                held = held.slice(0, size)
                held = held.set_column(len(keys), "n", pc.subtract(held["n"], cutoff)).filter(pc.field("n") > 0)
                missed += cutoff
        if held is not None:
            out = held.append_column("missed", pa.nulls(held.num_rows, pa.int64()))
            last = pa.table({**{k: pa.nulls(1, pa.string()) for k in keys}, "n": pa.nulls(1, pa.int64()), "missed": pa.array([missed], pa.int64())})
            yield from pa.concat_tables([out, last]).combine_chunks().to_batches()

    return rows.select(*[F.col(k).cast("string").alias(k) for k in keys], "n").mapInArrow(summarize, schema)


def most_frequent(rows: DataFrame, keys: list[str], first: str, top: int, size: int = SIZE) -> DataFrame:
    """keys, count, first and rank of the `top` most frequent keys of rows (keys, n, first), ties by `first`. Keys are strings and not null.

    Rows are read several times: give a stored table.
    """
    while True:
        found = cut(summaries(rows, keys, size), "summaries")
        missed = found.agg(F.coalesce(F.sum("missed"), F.lit(0)).alias("missed")).first().missed
        names = found.filter("missed is null").select(*keys).distinct()
        counted = rows.join(names, keys, "left_semi").groupBy(*keys).agg(F.sum("n").alias("count"), F.min(first).alias("first"))
        order = Window.orderBy(F.desc("count"), "first")
        # No more rows than counters, and Spark keeps `top` of each task before it ranks them.
        ranked = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        ranked = cut(ranked, "frequent")
        least = ranked.agg(F.count(F.lit(1)).alias("rows"), F.min("count").alias("least")).first()
        if not missed or (least.rows == top and least.least > missed):
            return ranked
        size *= 8
