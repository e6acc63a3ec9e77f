"""Extraction and quality queries over listing pages rendered from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import quality
from pagequarry.operators.extract import extract_products, extract_rows
from pagequarry.queries.listing import EXPECTED, SELECTORS, listing_pages
from pagequarry.queries.registry import joined, query
from pagequarry.schema import FIELDS
from pagequarry.sources.storage import cut

FIELD_LIST = ", ".join(FIELDS)


def products(spark, sf_dir):
    return extract_products(listing_pages(spark, sf_dir), SELECTORS).drop("scraped_at", "url")


def stored_products(spark, sf_dir):
    """For reports that read the products more than once: pages are parsed for the table, then no more."""
    return cut(products(spark, sf_dir), "products")


def _with(sql: str, *more: str) -> str:
    return "with " + ", ".join([EXPECTED, *more]) + sql


# Long form and per-field counts of the expected rows.
LONG = f"""long as (select site, page_id, "index", f as field, v as value from products
 cross join lateral (values {", ".join(f"('{f}', {f})" for f in FIELDS)}) as t(f, v))
"""
PERF = """perf as (select site, field, count(*) as total, count(value) as valid from long group by all)
"""
STATUS = """case when valid * 100 >= total * 80 then 'GOOD' when valid * 100 >= total * 50
 then 'NEEDS_IMPROVEMENT' else 'POOR' end"""
NUMBER = "try_cast(nullif(regexp_extract(value, '[0-9]+\\.?[0-9]*'), '') as double)"


@query(
    "listing_products",
    _with(f'select site, page_id, "index", {FIELD_LIST} from products'),
)
def listing_products(spark, sf_dir):
    return products(spark, sf_dir).select("site", "page_id", "index", *FIELDS)


@query(
    "listing_containers",
    _with('select page_id, count(*) as containers, max("index") as last_index from extracted group by page_id'),
)
def listing_containers(spark, sf_dir):
    boxes = extract_rows(listing_pages(spark, sf_dir), SELECTORS, fields=())
    return boxes.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("containers"), F.max("index").alias("last_index")
    )


@query(
    "listing_rejected_rows",
    _with('select page_id, "index" from extracted where name is null and current_price is null'),
)
def listing_rejected_rows(spark, sf_dir):
    rows = extract_rows(listing_pages(spark, sf_dir), SELECTORS)
    from pagequarry.operators.extract import valid_product

    return rows.filter(~valid_product()).select("page_id", "index")


@query(
    "field_performance",
    _with(
        f"""select site, field, total, valid, total - valid as failed,
 valid * 100.0::double / total as success_rate, {STATUS} as status from perf""",
        LONG,
        PERF,
    ),
)
def field_performance(spark, sf_dir):
    return quality.field_performance(products(spark, sf_dir))


@query(
    "site_performance",
    _with(
        """select site, max(total) as total_products, sum(valid)::bigint as valid_values,
 sum(valid)::bigint * 100.0::double / (max(total) * 9) as overall_success_rate from perf group by site""",
        LONG,
        PERF,
    ),
)
def site_performance(spark, sf_dir):
    return quality.site_performance(products(spark, sf_dir))


@query(
    "performance_rollup",
    _with(
        """select site, field, sum(total)::bigint as attempts, sum(valid)::bigint as valid,
 sum(valid)::bigint * 100.0::double / sum(total)::bigint as success_rate from perf group by rollup(site, field)""",
        LONG,
        PERF,
    ),
)
def performance_rollup(spark, sf_dir):
    return quality.performance_rollup(products(spark, sf_dir))


def _validation_sql(fields: str, extra: str = "", numeric: bool = True) -> str:
    number = f"count({NUMBER}) as numeric_extractions," if numeric else ""
    return _with(
        f"""select c.site, c.field, total, valid as valid_extractions,
 {'numeric_extractions,' if numeric else ''} {extra and extra.split(' as ')[-1] + ','}
 valid * 100.0::double / total as success_rate, {STATUS} as status,
 case when valid * 100 >= total * 80 then 'Selector working well'
  else 'Consider improving ' || c.field || ' selectors' end as recommendation,
 coalesce(sample_data, '') as sample_data
 from counts c left join taken t on c.site = t.site and c.field = t.field""",
        LONG,
        f"""counts as (select site, field, count(*) as total, count(value) as valid, {number} {extra}
 from long where field in ({fields}) group by site, field)""",
        f"""taken as (select site, field, string_agg(value, '|' order by nth) as sample_data from (
  select site, field, value, row_number() over (partition by site, field order by page_id, "index") as nth
  from long where value is not null and field in ({fields})) where nth <= 5 group by site, field)""",
    )


def _shown(report):
    return report.withColumn("sample_data", joined("sample_data"))


@query("validate_prices", _validation_sql("'current_price', 'original_price'"))
def validate_prices(spark, sf_dir):
    return _shown(quality.validate_prices(stored_products(spark, sf_dir)))


@query(
    "validate_ratings",
    _validation_sql(
        "'rating'",
        f"count(*) filter (where {NUMBER} between 0 and 5) as valid_range_extractions",
    ),
)
def validate_ratings(spark, sf_dir):
    return _shown(quality.validate_ratings(stored_products(spark, sf_dir)))


@query("validate_reviews", _validation_sql("'reviews'"))
def validate_reviews(spark, sf_dir):
    return _shown(quality.validate_reviews(stored_products(spark, sf_dir)))


@query(
    "validate_names",
    _validation_sql(
        "'name'",
        "count(*) filter (where length(value) between 5 and 200) as reasonable_length_extractions",
        numeric=False,
    ),
)
def validate_names(spark, sf_dir):
    return _shown(quality.validate_names(stored_products(spark, sf_dir)))


FIELD_POSITION = f"list_position([{', '.join(repr(f) for f in FIELDS)}], field)"
RATES = "rates as (select *, round(valid * 100.0::double / total, 1) as rate from perf)"
HEALTH = f"""health as (select site, max(total) as total_products, avg(rate) as score,
 coalesce(string_agg(field || ' selector is failing (' || printf('%.1f', rate) || '% success rate)', '|'
  order by {FIELD_POSITION}) filter (where rate < 50), '') as critical_issues,
 coalesce(string_agg('Consider improving ' || field || ' selectors (' || printf('%.1f', rate) || '% success rate)', '|'
  order by {FIELD_POSITION}) filter (where rate >= 50 and rate < 80), '') as recommendations
 from rates group by site)"""
HEALTH_STATUS = """case when score >= 90 then 'EXCELLENT' when score >= 80 then 'GOOD'
 when score >= 60 then 'NEEDS_IMPROVEMENT' else 'POOR' end"""


@query(
    "health_report",
    _with(
        f"""select site, total_products, round(score, 6) as score, {HEALTH_STATUS} as status,
 critical_issues, recommendations from health""",
        LONG,
        PERF,
        RATES,
        HEALTH,
    ),
)
def health_report(spark, sf_dir):
    report = quality.health_report(quality.field_performance(products(spark, sf_dir)))
    return report.select(
        "site",
        "total_products",
        F.round("score", 6).alias("score"),
        "status",
        joined("critical_issues").alias("critical_issues"),
        joined("recommendations").alias("recommendations"),
    )


SUGGESTED = ", ".join(f"'{f}'" for f in quality.SUGGESTED_FIELDS)


@query(
    "improvement_suggestions",
    _with(
        """select r.site, r.field, valid * 100.0::double / total as success_rate,
 case when valid * 100 < total * 50 then 'high' when valid * 100 < total * 80 then 'medium' else 'low' end as priority,
 case when valid * 100 < total * 50 then 'Only ' else '' end || printf('%.1f', rate) || '% success rate' as issue,
 case when valid * 100 < total * 50 then 'Review and update ' || r.field ||
   ' selectors - consider adding more fallback selectors or changing selector strategy'
  when valid * 100 < total * 80 then 'Consider adding fallback selectors for ' || r.field || ' to improve reliability'
  else 'Minor improvements possible for ' || r.field || ' selectors' end as suggestion,
 repeat('N/A|', least(total - valid, 3)::bigint - 1) || 'N/A' as sample_failures
 from rates r where valid * 100 < total * 95 and r.field in (""" + SUGGESTED + ")",
        LONG,
        PERF,
        RATES,
    ),
)
def improvement_suggestions(spark, sf_dir):
    out = quality.improvement_suggestions(stored_products(spark, sf_dir))
    return out.withColumn("sample_failures", joined("sample_failures"))


@query(
    "inspect_fields",
    _with(
        """select site, field, total, total - valid as na_count, valid as valid_count,
 (total - valid) * 100.0::double / total as na_percentage,
 case when (total - valid) * 100 < total * 20 then 'GOOD' when (total - valid) * 100 < total * 50
  then 'NEEDS_IMPROVEMENT' else 'POOR' end as status,
 round((total - valid) * 100.0::double / total, 1) >= 50 as is_problem
 from perf where field in (""" + SUGGESTED + ")",
        LONG,
        PERF,
    ),
)
def inspect_fields(spark, sf_dir):
    return quality.inspect_fields(products(spark, sf_dir))


@query(
    "inspect_samples",
    _with(
        f"""select site, field, string_agg(value, '|' order by nth) as sample_data from (
  select site, field, value, row_number() over (partition by site, field order by page_id, "index") as nth
  from long where value is not null and field in ({SUGGESTED})) where nth <= 3 group by site, field""",
        LONG,
    ),
)
def inspect_samples(spark, sf_dir):
    return _shown(quality.inspect_samples(products(spark, sf_dir)))


@query(
    "inspect_missing_rows",
    _with('select page_id, "index", name from products where rating is null order by page_id, "index" limit 10'),
)
def inspect_missing_rows(spark, sf_dir):
    rows = quality.inspect_rows(products(spark, sf_dir), "rating", only_missing=True)
    return rows.select("page_id", "index", "name")


@query(
    "systematic_sample",
    _with(
        """select page_id, "index", name from (select *, row_number() over (order by page_id, "index") - 1 as p,
 count(*) over () as n from products)
 where p in (select cast(floor(i * (select count(*) from products) / 25.0::double) as bigint) from range(25) t(i))"""
    ),
)
def systematic_sample(spark, sf_dir):
    picked = quality.systematic_sample(products(spark, sf_dir), 25)
    return picked.select("page_id", "index", "name")


@query(
    "scrape_counts",
    _with(
        """select site, count(*) as total_products, count(name) as with_names, count(current_price) as with_prices,
 count(rating) as with_ratings from products group by site"""
    ),
)
def scrape_counts(spark, sf_dir):
    return quality.scrape_counts(products(spark, sf_dir))


@query("products_per_site", _with("select site, count(*) as products from products group by site"))
def products_per_site(spark, sf_dir):
    return quality.products_per_site(products(spark, sf_dir))


@query(
    "first_products",
    _with(
        'select page_id, "index", site, name, current_price, rating, reviews from products order by page_id, "index" limit 5'
    ),
)
def first_products(spark, sf_dir):
    return quality.first_products(products(spark, sf_dir))


@query(
    "platform_record",
    _with(
        "select site as platform, count(*) as scraped_count, "
        + ", ".join(f"count({f}) * 100.0::double / count(*) as {f}" for f in FIELDS[:6])
        + " from products group by site"
    ),
)
def platform_record(spark, sf_dir):
    return quality.platform_record(products(spark, sf_dir))


@query(
    "price_and_name_checks",
    _with(
        """select site, count(*) filter (where cast(current_price as double) between 905 and 950) as prices_in_range,
 count(distinct name) as distinct_names, count(name) as names from products group by site"""
    ),
)
def price_and_name_checks(spark, sf_dir):
    return quality.price_and_name_checks(products(spark, sf_dir), 905, 950)


@query(
    "overall_rate_from_text",
    _with(
        """select site, cast(printf('%.1f', round(sum(valid)::bigint * 100.0::double / (max(total) * 9), 1)) as double) as rate
 from perf group by site""",
        LONG,
        PERF,
    ),
)
def overall_rate_from_text(spark, sf_dir):
    sites = quality.site_performance(products(spark, sf_dir))
    text = F.format_string("%.1f%%", F.round("overall_success_rate", 1))
    return sites.select("site", quality.rate_from_text(text).alias("rate"))


@query(
    "validation_summary",
    _with(
        f"""select site, 'field' as section, field, printf('%.1f', rate) || '%' as rate, {STATUS} as status from rates
 union all select site, 'overall', null, printf('%.1f', round(score, 1)) || '%', {HEALTH_STATUS} from health
 union all select site, 'critical', unnest(string_split(critical_issues, '|')), null, null from health where critical_issues <> ''""",
        LONG,
        PERF,
        RATES,
        HEALTH,
    ),
)
def validation_summary(spark, sf_dir):
    return quality.validation_summary(stored_products(spark, sf_dir))


@query("comprehensive_analysis")
def comprehensive_analysis(spark, sf_dir):
    out = quality.comprehensive_analysis(products(spark, sf_dir))
    return out.select("site", F.to_json(F.struct(*out.columns)).alias("analysis"))
