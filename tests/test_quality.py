"""Quality reports on small product tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagequarry.functions.text import first_number, has_value, platform_of, strip
from pagequarry.operators import quality
from pagequarry.schema import FIELDS
from pagequarry.sources import sinks


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        ("s", i // 7, i % 7 + 1, f"name {i}", "N/A" if i % 2 else "₹1,299", " " if i % 3 else "4.5")
        for i in range(40)
    ]
    base = spark.createDataFrame(rows, "site string, page_id bigint, index int, name string, current_price string, rating string")
    rest = [f for f in FIELDS if f not in base.columns]
    return base.withColumns({f: F.lit(None).cast("string") for f in rest})


@pytest.mark.parametrize(
    "value,valid,number",
    [("₹1,299", True, 1.0), ("4.5 of 5", True, 4.5), ("N/A", False, None), (" ", False, None), ("x", True, None), ("7.", True, 7.0)],
)
def test_value_checks(spark, value, valid, number):
    row = spark.createDataFrame([(value,)], "v string").select(has_value(F.col("v")), first_number(F.col("v"))).first()
    assert tuple(row) == (valid, number)


def test_status_bands_are_exact(spark):
    rows = spark.createDataFrame([(80, 100), (79, 100), (50, 100), (49, 100), (4, 5)], "v int, t int")
    got = [r[0] for r in rows.select(quality.status(F.col("v"), F.col("t"))).collect()]
    assert got == ["GOOD", "NEEDS_IMPROVEMENT", "NEEDS_IMPROVEMENT", "POOR", "GOOD"]


def test_missing_markers_and_blanks(products):
    rows = {r.field: r for r in quality.field_performance(products).collect()}
    assert (rows["current_price"].valid, rows["rating"].valid, rows["reviews"].valid) == (20, 14, 0)
    view = {r.field: r for r in quality.inspect_fields(products).collect()}
    assert view["rating"].na_count == 0 and view["current_price"].na_count == 20
    assert view["current_price"].is_problem


@pytest.mark.parametrize("limit", [1, 3, 7, 39, 40, 41, 100])
def test_systematic_sample_positions(products, limit):
    got = sorted((r.page_id, r["index"]) for r in quality.systematic_sample(products, limit).collect())
    order = sorted((i // 7, i % 7 + 1) for i in range(40))
    want = [order[int(i * 40 / limit)] for i in range(limit)] if limit < 40 else order
    assert got == sorted(want)


def test_samples_are_the_first_values(products):
    row = quality.validate_ratings(products).first()
    assert row.sample_data == ["4.5"] * 5
    assert (row.valid_extractions, row.valid_range_extractions, row.status) == (14, 14, "POOR")


def test_empty_input_gives_no_rows(products):
    none = products.filter("false")
    assert quality.field_performance(none).count() == 0
    assert quality.health_report(quality.field_performance(none)).count() == 0


def test_stored_form(products, tmp_path):
    rows = products.filter("page_id = 0 and index <= 2").withColumn(
        "offers", F.array(F.lit("a"), F.lit("b"))
    ).withColumn("scraped_at", F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5)))
    stored = {r["index"]: r for r in sinks.stored_products(rows).collect()}
    assert stored[2].current_price == "N/A" and stored[1].offers == "a; b"
    assert stored[1].scraped_at == "2024-01-02T03:04:05"
    assert sinks.write_csv(sinks.stored_products(rows), str(tmp_path / "c")) == 2
    outcome = sinks.append_products(products.filter("false"), str(tmp_path / "t")).first()
    assert (outcome.success, outcome.saved_count, outcome.error) == (False, 0, "No products to save")


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c\nd', "é")], "x string, y string")
    sinks.write_csv(rows, str(tmp_path / "q"))
    assert sinks.read_csv(spark, str(tmp_path / "q"), rows.schema).collect() == rows.collect()


def test_strip_and_platform(spark):
    row = spark.range(1).select(
        strip(F.lit(" \t a b　\n")).alias("s"),
        platform_of(F.lit("https://www.Amazon.in/x"), ("flipkart", "amazon")).alias("p"),
    ).first()
    assert (row.s, row.p) == ("a b", "amazon")


def test_html_files(spark, tmp_path):
    from pagequarry.sources.pages import read_html_files

    (tmp_path / "a.html").write_bytes("<p>é</p>".encode() + b"\xff!")
    (tmp_path / "b.html").write_bytes("<p>�</p>".encode())
    rows = sorted(r.html for r in read_html_files(spark, str(tmp_path)).collect())
    assert rows == ["<p>é</p>!", "<p>�</p>"]
