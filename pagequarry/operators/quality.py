"""Extraction-quality analytics over product rows.

One pass turns each product row into per-field facts and aggregates them by site; every report below
is a second, tiny aggregate over that result. Sites may be few and hot: counts are partially
aggregated before the shuffle, and samples use per-group row numbers, which Spark prunes to the
requested few per task before it shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import first_number, has_value
from pagequarry.schema import FIELDS, MISSING
from pagequarry.sources.storage import cut

# Status bands in percent, and the fields each report covers.
GOOD, FAIR = 80, 50
HEALTH_BANDS = ((90, "EXCELLENT"), (80, "GOOD"), (60, "NEEDS_IMPROVEMENT"))
SUGGESTED_FIELDS = FIELDS[:7]
SAMPLES = 5
FAILURES = 3
ORDER = ("page_id", "index")


def status(valid: Column, total: Column) -> Column:
    """Band of a success rate, decided on whole numbers."""
    return (
        F.when(valid * 100 >= total * GOOD, "GOOD")
        .when(valid * 100 >= total * FAIR, "NEEDS_IMPROVEMENT")
        .otherwise("POOR")
    )


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole)


def long_form(products: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per product and field."""
    ids = [c for c in ("site", *ORDER, "scraped_at") if c in products.columns]
    return products.unpivot(ids, list(fields), "field", "value")


def _field_order(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))


def _wide_counts(products: DataFrame, by: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Total and valid counts of every field in one aggregate; rows are not multiplied by fields."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(has_value(F.col(f))).alias(f) for f in fields]
    return products.groupBy(*by).agg(*aggs)


def field_performance(
    products: DataFrame, by: tuple[str, ...] = ("site",), fields: tuple[str, ...] = FIELDS
) -> DataFrame:
    """Per group and field: total, valid, failed, success_rate (percent) and status."""
    counts = _wide_counts(products, by, fields)
    return counts.unpivot([*by, "total"], list(fields), "field", "valid").select(
        *by,
        "field",
        "total",
        "valid",
        (F.col("total") - F.col("valid")).alias("failed"),
        percent(F.col("valid"), F.col("total")).alias("success_rate"),
        status(F.col("valid"), F.col("total")).alias("status"),
    )


def site_performance(products: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per site: products, valid values over all fields and the overall success rate."""
    counts = _wide_counts(products, ("site",), fields)
    valid = reduce(Column.__add__, [F.col(f) for f in fields])
    return counts.select(
        "site",
        F.col("total").alias("total_products"),
        valid.alias("valid_values"),
        percent(valid, F.col("total") * len(fields)).alias("overall_success_rate"),
    )


def performance_rollup(products: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Field, site and corpus totals in one result; NULL site or field stands for all."""
    per_field = field_performance(products, fields=fields)
    return per_field.rollup("site", "field").agg(
        F.sum("total").alias("attempts"),
        F.sum("valid").alias("valid"),
        percent(F.sum("valid"), F.sum("total")).alias("success_rate"),
    )


def first_scrape(products: DataFrame) -> DataFrame:
    """Per site: the scrape time of its first product row."""
    return products.groupBy("site").agg(
        F.min_by("scraped_at", F.struct(*ORDER)).alias("scraped_at")
    )


def samples(products: DataFrame, fields: tuple[str, ...], keep: Column, n: int) -> DataFrame:
    """Per site and field: the first n values for which `keep` holds, as an ordered array."""
    order = Window.partitionBy("site", "field").orderBy(*ORDER)
    few = (
        long_form(products, fields)
        .filter(keep)
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= n)
    )
    listed = F.array_sort(F.collect_list(F.struct("nth", "value")))
    return few.groupBy("site", "field").agg(
        F.transform(listed, lambda s: s["value"]).alias("sample_data")
    )


def _validation(products: DataFrame, fields: tuple[str, ...], extra: dict[str, Column]) -> DataFrame:
    """Counts, status, samples and advice for some fields; `extra` adds conditional counts on value."""
    rows = long_form(products, fields)
    value = F.col("value")
    counts = rows.groupBy("site", "field").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has_value(value)).alias("valid_extractions"),
        F.count(first_number(value)).alias("numeric_extractions"),
        *[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in extra.items()],
    )
    total, valid = F.col("total"), F.col("valid_extractions")
    judged = counts.select(
        "*",
        percent(valid, total).alias("success_rate"),
        status(valid, total).alias("status"),
        F.when(valid * 100 >= total * GOOD, "Selector working well")
        .otherwise(F.concat(F.lit("Consider improving "), F.col("field"), F.lit(" selectors")))
        .alias("recommendation"),
    )
    taken = samples(products, fields, has_value(value), SAMPLES)
    none = F.array().cast("array<string>")
    return judged.join(taken, ["site", "field"], "left").withColumn(
        "sample_data", F.coalesce("sample_data", none)
    )


def validate_prices(products: DataFrame) -> DataFrame:
    return _validation(products, ("current_price", "original_price"), {})


def validate_ratings(products: DataFrame) -> DataFrame:
    in_range = first_number(F.col("value")).between(0, 5)
    return _validation(products, ("rating",), {"valid_range_extractions": in_range})


def validate_reviews(products: DataFrame) -> DataFrame:
    return _validation(products, ("reviews",), {})


def validate_names(products: DataFrame) -> DataFrame:
    fits = has_value(F.col("value")) & F.length("value").between(5, 200)
    out = _validation(products, ("name",), {"reasonable_length_extractions": fits})
    return out.drop("numeric_extractions")


def health_report(performance: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per site: score (mean of field rates rounded to 0.1), status, critical issues (below 50) and
    recommendations (below 80), both judged on the rounded rates, in field order."""
    rate = F.round("success_rate", 1)
    shown = F.format_string("%.1f", rate)
    order = _field_order(fields)
    critical = F.when(
        rate < FAIR,
        F.struct(order.alias("o"), F.concat("field", F.lit(" selector is failing ("), shown, F.lit("% success rate)")).alias("t")),
    )
    advice = F.when(
        (rate >= FAIR) & (rate < GOOD),
        F.struct(order.alias("o"), F.concat(F.lit("Consider improving "), "field", F.lit(" selectors ("), shown, F.lit("% success rate)")).alias("t")),
    )

    def listed(events):
        return F.transform(F.array_sort(F.collect_list(events)), lambda e: e["t"])

    score = F.col("score")
    band = F.lit("POOR")
    for floor, label in reversed(HEALTH_BANDS):
        band = F.when(score >= floor, label).otherwise(band)
    return (
        performance.groupBy("site")
        .agg(
            F.max("total").alias("total_products"),
            F.avg(rate).alias("score"),
            listed(critical).alias("critical_issues"),
            listed(advice).alias("recommendations"),
        )
        .withColumn("status", band)
    )


# The wording of statuses, issues and suggestions here and above.
def improvement_suggestions(products: DataFrame) -> DataFrame:
    """Per site and field below 95 percent: priority, issue, suggestion and first failing values."""
    fields = SUGGESTED_FIELDS
    per_field = field_performance(products, fields=fields)
    valid, total, name = F.col("valid"), F.col("total"), F.col("field")
    rate = F.format_string("%.1f%%", F.round("success_rate", 1))
    high, medium, low = (valid * 100 < total * x for x in (FAIR, GOOD, 95))
    judged = per_field.filter(low).select(
        "site",
        "field",
        "success_rate",
        F.when(high, "high").when(medium, "medium").otherwise("low").alias("priority"),
        F.when(high, F.concat(F.lit("Only "), rate, F.lit(" success rate")))
        .otherwise(F.concat(rate, F.lit(" success rate")))
        .alias("issue"),
        F.when(
            high,
            F.concat(
                F.lit("Review and update "),
                name,
                F.lit(" selectors - consider adding more fallback selectors or changing selector strategy"),
            ),
        )
        .when(
            medium,
            F.concat(F.lit("Consider adding fallback selectors for "), name, F.lit(" to improve reliability")),
        )
        .otherwise(F.concat(F.lit("Minor improvements possible for "), name, F.lit(" selectors")))
        .alias("suggestion"),
    )
    shown = products.select(
        "site", *ORDER, *[F.coalesce(F.col(f), F.lit(MISSING)).alias(f) for f in fields]
    )
    failing = samples(shown, fields, ~has_value(F.col("value")), FAILURES)
    return judged.join(failing.withColumnRenamed("sample_data", "sample_failures"), ["site", "field"], "left")


def inspect_fields(products: DataFrame, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """Missing-value view: a blank-only value counts as present here, and the bands are on the
    missing share (below 20 GOOD, below 50 NEEDS_IMPROVEMENT)."""
    fields = SUGGESTED_FIELDS
    missing = {f: F.col(f).isNull() | F.col(f).isin(MISSING, "") for f in fields}
    counts = products.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(m).alias(f) for f, m in missing.items()]
    )
    na, total = F.col("na_count"), F.col("total")
    share = percent(na, total)
    return counts.unpivot([*by, "total"], list(fields), "field", "na_count").select(
        *by,
        "field",
        "total",
        "na_count",
        (total - na).alias("valid_count"),
        share.alias("na_percentage"),
        F.when(na * 100 < total * (100 - GOOD), "GOOD")
        .when(na * 100 < total * (100 - FAIR), "NEEDS_IMPROVEMENT")
        .otherwise("POOR")
        .alias("status"),
        (F.round(share, 1) >= 100 - FAIR).alias("is_problem"),
    )


def inspect_samples(products: DataFrame) -> DataFrame:
    """Per site and field: the first three present values."""
    present = F.col("value").isNotNull() & ~F.col("value").isin(MISSING, "")
    return samples(products, SUGGESTED_FIELDS, present, FAILURES)


def inspect_rows(products: DataFrame, field: str | None = None, only_missing: bool = False, limit: int = 10) -> DataFrame:
    """First rows, optionally only those where a field is missing."""
    rows = products
    if field and only_missing:
        rows = rows.filter(F.col(field).isNull() | (F.col(field) == MISSING))
    return rows.orderBy(*ORDER).limit(limit)


def systematic_sample(rows: DataFrame, limit: int = 10, order: tuple[str, ...] = ORDER) -> DataFrame:
    """`limit` rows at even steps of the row order, all rows where there are no more than that.

    Positions come from two levels: rows are counted per page (the first order column, of any type
    that can be ordered), page sizes are summed up, and only then are the wanted positions looked up,
    so no task orders the whole table.
    """
    page, *rest = order
    rows = cut(rows, "sampled")
    sizes = rows.groupBy(page).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).scalar()
    placed = _running_total(sizes, page, "size").withColumn("n", total)

    # Step i asks for position floor(i * n / limit): the first i at or past `at` is its ceiling.
    def first_step(at: Column) -> Column:
        return F.expr("cast(null as bigint)") if limit < 1 else F.ceil(at * limit / F.col("n"))

    start, stop = F.col("start"), F.col("start") + F.col("size")
    low, high = first_step(start), F.least(first_step(stop), F.lit(limit)) - 1
    steps = F.transform(
        F.sequence(low, high), lambda i: F.floor(i * F.col("n") / limit) - F.col("start") + 1
    )
    everything = F.sequence(F.lit(1).cast("bigint"), F.col("size"))
    wanted = F.when(F.col("n") <= limit, everything).when(low <= high, steps)
    # At most `limit` rows.
    hits = placed.select(page, F.explode(wanted).alias("nth"))
    numbered = rows.join(hits.select(page).distinct(), page, "left_semi").withColumn(
        "nth", F.row_number().over(Window.partitionBy(page).orderBy(*rest)).cast("bigint")
    )
    return numbered.join(hits, [page, "nth"]).drop("nth").select(*rows.columns)


def _running_total(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """`start` = sum of `size` over smaller keys, without one task seeing all keys: keys are dealt out by
    range, totals run over the ranges, then within each. The dealt rows are written, so that both
    uses see the same ranges; there are as many of these as the session has shuffle partitions."""
    ranged = cut(sizes.repartitionByRange(key).select(key, size, F.spark_partition_id().alias("r")), "ranges")
    ranges = ranged.groupBy("r").agg(F.sum(size).alias("in_range"))
    upto = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranges.select("r", F.coalesce(F.sum("in_range").over(upto), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(starts, "r")
        .withColumn("start", F.col("range_start") + F.coalesce(F.sum(size).over(within), F.lit(0)))
        .select(key, size, "start")
    )


def scrape_counts(products: DataFrame) -> DataFrame:
    """Per site: rows, and rows with a name, a price and a rating."""
    return products.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count("name").alias("with_names"),
        F.count("current_price").alias("with_prices"),
        F.count("rating").alias("with_ratings"),
    )


def products_per_site(products: DataFrame) -> DataFrame:
    return products.groupBy("site").agg(F.count(F.lit(1)).alias("products"))


def first_products(products: DataFrame, n: int = SAMPLES) -> DataFrame:
    return products.orderBy(*ORDER).limit(n).select(
        *ORDER, "site", "name", "current_price", "rating", "reviews"
    )


def rate_from_text(rate: Column) -> Column:
    """"83.3%" to 83.3; anything else to 0."""
    return F.coalesce(F.replace(rate, F.lit("%"), F.lit("")).try_cast("double"), F.lit(0.0))


def platform_record(products: DataFrame, fields: tuple[str, ...] = FIELDS[:6]) -> DataFrame:
    """One row per site: product count and one success-rate column per field."""
    counts = _wide_counts(products, ("site",), fields)
    return counts.select(
        F.col("site").alias("platform"),
        F.col("total").alias("scraped_count"),
        *[percent(F.col(f), F.col("total")).alias(f) for f in fields],
    )


def price_and_name_checks(products: DataFrame, low: float, high: float) -> DataFrame:
    """Per site: prices in a range and distinct names."""
    price = F.replace(F.col("current_price"), F.lit(","), F.lit(""))
    number = F.regexp_extract(price, r"[0-9]+\.?[0-9]*", 0).try_cast("double")
    return products.groupBy("site").agg(
        F.count_if(number.between(low, high)).alias("prices_in_range"),
        F.count_distinct("name").alias("distinct_names"),
        F.count("name").alias("names"),
    )


def comprehensive_analysis(products: DataFrame) -> DataFrame:
    """Per site one struct with every report, all over one stored copy of the products."""
    products = cut(products, "products")
    per_field = field_performance(products)
    health = health_report(per_field)
    reports = {
        "selector_performance": per_field,
        "price_validation": validate_prices(products),
        "rating_validation": validate_ratings(products),
        "review_validation": validate_reviews(products),
        "name_validation": validate_names(products),
        "improvement_suggestions": improvement_suggestions(products),
    }
    out = health.select("site", F.struct(*[c for c in health.columns if c != "site"]).alias("validation_report"))
    for name, report in reports.items():
        entry = F.struct(*[c for c in report.columns if c != "site"])
        nested = report.groupBy("site").agg(F.array_sort(F.collect_list(entry)).alias(name))
        out = out.join(nested, "site", "left")
    return out


def validation_summary(products: DataFrame) -> DataFrame:
    """Printable view: one line per site and field with rate and status, then one per issue."""
    per_field = field_performance(products)
    health = health_report(per_field)
    lines = per_field.select(
        "site",
        F.lit("field").alias("section"),
        "field",
        F.format_string("%.1f%%", F.round("success_rate", 1)).alias("rate"),
        "status",
    )
    issues = health.select("site", F.explode("critical_issues").alias("field")).select(
        "site", F.lit("critical").alias("section"), "field", F.lit(None).cast("string").alias("rate"), F.lit(None).cast("string").alias("status")
    )
    overall = health.select(
        "site",
        F.lit("overall").alias("section"),
        F.lit(None).cast("string").alias("field"),
        F.format_string("%.1f%%", F.round("score", 1)).alias("rate"),
        "status",
    )
    return overall.unionByName(lines).unionByName(issues)
