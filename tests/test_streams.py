"""Rates of a stream behind a watermark, late rows and visits."""

import datetime

from pyspark.sql import functions as F

from pagequarry.queries import flow_queries
from pagequarry.schema import FIELDS
from pagequarry.streaming import continuous

START = datetime.datetime(2024, 1, 1)


def product(hours, site="s", name="n"):
    return (START + datetime.timedelta(hours=hours), site, name)


def table(spark, rows):
    some = spark.createDataFrame(rows, "scraped_at timestamp, site string, name string")
    return some.select("*", *[F.lit(None).cast("string").alias(f) for f in FIELDS if f != "name"])


def run(spark, tmp_path, batches, again=()):
    """One file a batch; the batches of `again` are stored a second time, as after a failure."""
    folder, found = str(tmp_path / "out"), str(tmp_path / "in")
    schema = table(spark, [product(0)]).schema
    for i, rows in enumerate(batches):
        table(spark, rows).coalesce(1).write.mode("append").parquet(found)
        stream = spark.readStream.schema(schema).parquet(found)
        continuous.rates_stream(stream, folder, str(tmp_path / "state"), "1 hour", "2 hours").awaitTermination()
        if i in again:
            replay(spark, table(spark, rows), folder, tmp_path / f"again{i}", i)
    return folder


def replay(spark, rows, folder, state, number):
    """Call the batch function once more with the same rows and number."""
    held = {}

    class Writer:
        def foreachBatch(self, store):
            held["store"] = store
            return self

        option = trigger = lambda self, *a, **b: self

        def start(self):
            held["store"](rows, number)

    class Stream:
        writeStream = Writer()

    continuous.rates_stream(Stream(), folder, str(state), "1 hour", "2 hours")


BATCHES = [[product(0), product(0.5), product(1, "t")], [product(4, "s", None), product(0.2)], [product(0.1), product(5), product(3.9)]]


def read(spark, folder):
    closed = {(r.window_start.hour, r.site): (r.total, r.name) for r in continuous.closed_windows(spark, folder).collect()}
    still = {(r.window_start.hour, r.site): (r.total, r.name) for r in continuous.open_windows(spark, folder).collect()}
    late = sorted((r.scraped_at.minute, r.site, r.batch) for r in continuous.late_rows(spark, folder).collect())
    return closed, still, late


def test_late_rows_are_kept_aside_and_windows_close_once(spark, tmp_path):
    closed, still, late = read(spark, run(spark, tmp_path, BATCHES))
    assert closed == {(0, "s"): (3, 3), (1, "t"): (1, 1)}
    assert still == {(3, "s"): (1, 1), (4, "s"): (1, 0), (5, "s"): (1, 1)}
    assert late == [(6, "s", 2)]


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    assert read(spark, run(spark, tmp_path, BATCHES, again=(1, 2))) == read(spark, run(spark, tmp_path / "once", BATCHES))


def test_what_is_carried_on_shrinks(spark, tmp_path):
    folder = run(spark, tmp_path, [[product(h) for h in range(20)], [product(100)]])
    sizes = [r.n for r in spark.read.parquet(f"{folder}/windows").filter("not closed").groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert sizes == [3, 1]


def test_landings_do_not_grow_in_number_and_lose_no_row(spark):
    times = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("id") * 7919, F.lit(40_000)) * 60)
    rows = spark.range(40_000).select(F.when(F.col("id") > 2, times).alias("scraped_at"), F.lit("s").alias("site"), F.lit("n").alias("name"))
    rows = rows.select("*", *[F.lit(None).cast("string").alias(f) for f in FIELDS if f != "name"]).repartition(3)
    folder = flow_queries._rates(spark, rows)
    marks = [r.mark for r in spark.read.parquet(f"{folder}/marks").orderBy("batch").collect()]
    assert 2 < len(marks) <= 8 and marks == sorted(set(marks))
    assert late_count(spark, folder) == 0
    counts = continuous.closed_windows(spark, folder).unionByName(continuous.open_windows(spark, folder))
    expected = rows.filter("scraped_at is not null").groupBy(F.date_trunc("hour", "scraped_at").alias("h")).count().collect()
    assert sorted((r.window_start, r.total, r.name) for r in counts.collect()) == sorted((r.h, r["count"], r["count"]) for r in expected)
    none = flow_queries._rates(spark, rows.limit(0))
    assert continuous.closed_windows(spark, none).count() == 0


def late_count(spark, folder):
    return continuous.late_rows(spark, folder).count()


def test_visits_end_at_gaps(spark):
    rows = [("u", "a", 0), ("u", "a", 0.5), ("u", "b", 1.2), ("u", "a", 5), ("v", "a", 0)]
    pages = spark.createDataFrame([(u, h, START + datetime.timedelta(hours=t)) for u, h, t in rows], "url string, html string, scraped_at timestamp")
    got = sorted((r.url, r.first_seen.hour, r.last_seen.hour, r.landings, r.changed) for r in continuous.visits(pages, "1 hour").collect())
    assert got == [("u", 0, 1, 3, True), ("u", 5, 5, 1, False), ("v", 0, 0, 1, False)]
