"""Groups and ranks inside an array column: what a report needs of one page, without a shuffle.

Every step is a column of its own, so that a value used twice is computed once. Lambdas see columns and not long
expressions for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_runs(rows: DataFrame, sorted_items: str, key: str, into: str) -> DataFrame:
    """Adds `into`: array of struct(at, count), the runs of equal `key` in an array of structs sorted by it."""
    size = F.size(sorted_items)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1))
    rows = rows.withColumn(f"{into}_places", places)

    def opens(i: Column) -> Column:
        before, here = F.get(F.col(sorted_items), i - 1), F.get(F.col(sorted_items), i)
        return (i == 0) | (before[key] != here[key])

    rows = rows.withColumn(f"{into}_starts", F.filter(f"{into}_places", opens))
    end = lambda j: F.coalesce(F.get(F.col(f"{into}_starts"), j + 1), F.size(sorted_items))
    runs = F.transform(f"{into}_starts", lambda a, j: F.struct(a.alias("at"), (end(j) - a).alias("count")))
    return rows.withColumn(into, runs).drop(f"{into}_places", f"{into}_starts")


def first(items: Column, n: int) -> Column:
    """The n smallest items of an array of structs, in their order."""
    return F.slice(F.sort_array(items), F.lit(1), F.lit(n))


def keep(rows: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns. A plain filter is pushed below the steps that compute them, with all steps written out in it,
    lambdas within lambdas; it stays above a projection that numbers the rows."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return rows.filter(condition & (F.col("_row") >= 0)).drop("_row")


def listed(rows: DataFrame, items: str, *others: str, into: str = "item") -> DataFrame:
    """One row per item of an array column, with its `rank` from 1. Rows without items go after the array is made, for the
    same reason as in `keep`."""
    rows = rows.select(*others, F.posexplode_outer(items).alias("_at", into)).filter(F.col("_at").isNotNull())
    return rows.withColumn("rank", F.col("_at") + 1).drop("_at")
