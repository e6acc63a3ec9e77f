"""Word and shingle arrays built with Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def own(rows: DataFrame) -> str:
    """A prefix that no column of the rows has: names made with it clash with none."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in rows.columns):
        prefix += "_"
    return prefix


def hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def paired(array: Column, gap: int) -> Column:
    """Hash of each element with the one `gap` places on; shorter by `gap`, empty where too short."""
    rest = F.greatest(F.size(array) - gap, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), rest), F.slice(array, F.lit(gap + 1), rest), lambda a, b: F.xxhash64(a, b))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.transform(F.array(value), body)[0]


def shingles(docs: DataFrame, source: Column, name: str) -> DataFrame:
    """Add a column with the hash of every run of five words.

    Every step is a column of its own: a step that is used twice is then computed once.
    """
    steps = [f"__{name}_{i}" for i in (1, 2, 4)]
    docs = docs.withColumn(steps[0], hashes(words(source)))
    docs = docs.withColumn(steps[1], paired(F.col(steps[0]), 1))
    docs = docs.withColumn(steps[2], paired(F.col(steps[1]), 2))
    one, four = F.col(steps[0]), F.col(steps[2])
    rest = F.greatest(F.size(one) - 4, F.lit(0))
    five = F.zip_with(F.slice(four, F.lit(1), rest), F.slice(one, F.lit(5), rest), lambda a, b: F.xxhash64(a, b))
    return docs.withColumn(name, five).drop(*steps)


def where(rows: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them twice.

    A filter is otherwise pushed below the projection, with every computed column written out in it; it
    stays above a projection that numbers the rows.
    """
    number = f"{own(rows)}row"
    rows = rows.withColumn(number, F.monotonically_increasing_id())
    return rows.where(condition & (F.col(number) >= 0)).drop(number)


def literal(values: list, kind: str) -> Column:
    """A constant array, folded by the optimizer. Only for tables of a fixed size."""
    return F.from_json(F.lit("[" + ",".join(repr(v) for v in values) + "]"), f"array<{kind}>")


def placed(rows: DataFrame, key: list[str], pieces: Column, found: Column, notes: Column | None = None) -> DataFrame:
    """One row per match with its character span.

    `pieces` is the text split at the matches, `found` the matches, `notes` an
    array with something to each match, kept as `note`. The key should be small: it goes with each match. The running sum is a window
    over one text's matches, so a text with very many of them spills instead of growing.
    """
    from pyspark.sql import Window

    with_notes = [] if notes is None else [notes.alias("note")]
    parts = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), *with_notes)
    rows = rows.select(*key, F.posexplode(parts).alias("at", "part"))
    rows = rows.select(*key, "at", F.length("part.gap").cast("long").alias("gap"), F.col("part.hit").alias("hit"), *["part.note"] * len(with_notes))
    before = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(before)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).drop("gap")
