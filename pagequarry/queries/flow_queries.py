"""Sinks, configuration tables, gated runs and streams over pages rendered from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions.text import TEMPLATE_PLATFORMS, LABEL_PLATFORMS, platform_of
from pagequarry.operators import config, quality
from pagequarry.operators.extract import ANY_SITE, Rule, css, extract_products, extract_rows, parse_once
from pagequarry.operators.heuristics import field_hints
from pagequarry.operators.sites import built_in_sites, platform_templates
from pagequarry.plans import workflow
from pagequarry.queries.listing import EXPECTED, SELECTORS, listing_pages
from pagequarry.queries.market import EXPECTED as MARKET
from pagequarry.queries.market import market_pages
from pagequarry.queries.listing_queries import FIELD_LIST, HEALTH_STATUS, LONG, PERF, products, stored_products
from pagequarry.queries.page_queries import pages
from pagequarry.queries.registry import query
from pagequarry.schema import FIELDS, PRODUCT_COLUMNS
from pagequarry.sources import runs, sinks
from pagequarry.sources.storage import cut, new_folder
from pagequarry.streaming import continuous

SHOPS = tuple(f"shop{i}" for i in range(4))
STORED = ", ".join(f"coalesce({f}, 'N/A') as {f}" for f in FIELDS)


def _with(sql: str, *more: str, base: str = EXPECTED) -> str:
    return "with " + ", ".join([base, *more]) + " " + sql


# -- sinks ----------------------------------------------------------------------------------------


@query("csv_round_trip", _with(f'select "index", {STORED}, site, \'N/A\' as scraped_at from products'))
def csv_round_trip(spark, sf_dir):
    rows = sinks.stored_products(products(spark, sf_dir))
    path = new_folder(spark, "csv")
    sinks.write_csv(rows, path)
    return sinks.read_csv(spark, path, rows.schema)


@query("json_round_trip", _with(f'select "index", {STORED}, site, \'N/A\' as scraped_at from products'))
def json_round_trip(spark, sf_dir):
    rows = sinks.stored_products(products(spark, sf_dir))
    path = new_folder(spark, "json")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(
    "table_append",
    _with(
        """select true as success, count(*) as saved_count, 'scraped_products' as table_name,
 'Successfully saved ' || count(*) || ' products to scraped_products' as message, null::varchar as error from products"""
    ),
)
def table_append(spark, sf_dir):
    return sinks.append_products(products(spark, sf_dir), new_folder(spark, "table"))


@query("table_rows", _with(f'select "index", {STORED}, site, \'N/A\' as scraped_at from products'))
def table_rows(spark, sf_dir):
    path = new_folder(spark, "table")
    sinks.append_products(products(spark, sf_dir), path)
    return sinks.read_products(spark, path)


#: Which sites each of two runs scrapes.
RUNS = {"first": SHOPS[:2], "second": SHOPS[2:]}


@query("repeated_append", _with(f'select "index", {STORED}, site, \'N/A\' as scraped_at from products'))
def repeated_append(spark, sf_dir):
    """Pages appended by two runs, one of them done twice and one attempt of it left without a commit. The pages are parsed once."""
    path, pages = new_folder(spark, "table"), listing_pages(spark, sf_dir)
    of_run = {name: F.col("site").isin(*sites) for name, sites in RUNS.items()}
    run_of = F.when(of_run["first"], "first").when(of_run["second"], "second")
    stored = cut(parse_once(pages, (SELECTORS, FIELDS)).withColumn("run_of", run_of), "parsed", by=("run_of",))
    parsed = {name: stored.filter(F.col("run_of") == name).drop("run_of") for name in RUNS}
    for name in ("first", "second", "first"):
        workflow.scrape_and_append(pages.filter(of_run[name]), SELECTORS, path, name, parsed[name])
    left = extract_products(pages.filter(of_run["second"]), SELECTORS, parsed=parsed["second"])
    runs.stage(sinks.stored_products(left), path, "second", ("site",))
    return sinks.read_products(spark, path)


@query(
    "appended_runs",
    _with("select 'run-' || (case when site in ('shop0', 'shop1') then 'first' else 'second' end) as run, count(*) as rows from products group by 1"),
)
def appended_runs(spark, sf_dir):
    path, pages = new_folder(spark, "table"), listing_pages(spark, sf_dir)
    for name, sites in RUNS.items():
        workflow.scrape_and_append(pages.filter(F.col("site").isin(*sites)), SELECTORS, path, name)
    return runs.commits(spark, path).select("run", "rows")


@query(
    "scrape_to_csv",
    _with(
        """select site, count(*) as total_products, count(name) as with_names, count(current_price) as with_prices,
 count(rating) as with_ratings from products group by site"""
    ),
)
def scrape_to_csv(spark, sf_dir):
    return workflow.scrape(listing_pages(spark, sf_dir), SELECTORS, new_folder(spark, "csv"))


@query("analysis_export")
def analysis_export(spark, sf_dir):
    path = new_folder(spark, "analysis")
    sinks.export_json(quality.comprehensive_analysis(products(spark, sf_dir)), path)
    return spark.read.text(path).select("site", "value")


# -- configurations -------------------------------------------------------------------------------


@query(
    "platforms",
    """select page_id, case when contains(lower(url), 'flipkart') then 'flipkart' when contains(lower(url), 'amazon') then 'amazon'
 when contains(lower(url), 'ebay') then 'ebay' else 'generic' end as platform,
 case when page_id % 2 = 0 then 'ajio' else 'generic' end as template from pages""",
)
def platforms(spark, sf_dir):
    """Every page; every other address is marked as one of a platform with a template."""
    marked = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/AJIO/"))).otherwise(F.col("url"))
    return pages(spark, sf_dir).select(
        "page_id",
        platform_of(F.col("url"), LABEL_PLATFORMS).alias("platform"),
        platform_of(marked, TEMPLATE_PLATFORMS).alias("template"),
    )


@query("selector_table_extraction", _with(f'select site, page_id, "index", {FIELD_LIST} from products'))
def selector_table_extraction(spark, sf_dir):
    """The configuration as a table, one copy per site, read back and compiled."""
    table = config.selector_table(spark, {s: SELECTORS[ANY_SITE] for s in SHOPS})
    rows = extract_products(listing_pages(spark, sf_dir), table)
    return rows.select("site", "page_id", "index", *FIELDS)


@query(
    "upserted_selectors",
    _with("""select page_id, "index", p_name as name, cast(price as varchar) as current_price
 from cards where k % 6 <> 0 and k % 13 <> 0"""),
)
def upserted_selectors(spark, sf_dir):
    current = config.selector_table(spark, {s: SELECTORS[ANY_SITE] for s in SHOPS})
    proposals = spark.createDataFrame(
        [(s, "name", "xpath", [".//img[1]/@alt"]) for s in SHOPS]
        + [(s, "colour", "css", ["b"]) for s in SHOPS]
        + [(s, "rating", "sql", ["b"]) for s in SHOPS]
        + [(s, "reviews", "css", []) for s in SHOPS],
        "site string, field string, type string, selectors array<string>",
    )
    table, _ = config.upsert_selectors(current, proposals)
    rows = extract_products(listing_pages(spark, sf_dir), table)
    return rows.filter("name is not null and current_price is not null").select(
        "page_id", "index", "name", "current_price"
    )


@query(
    "converted_sites",
    _with(
        """select site, count(*) as containers, count(case when k % 13 <> 0 or (site = 'sathya' and (k % 2 = 0 or k % 5 = 4)) then 1 end) as priced
 from market where site in ('meesho', 'sathya') or (site = 'amazon') group by site""",
        base=MARKET,
    ),
)
def converted_sites(spark, sf_dir):
    keys = {field: key for key, field in config.OLD_KEYS.items()}
    old = [
        (site, keys[field], [r.selector for r in rules])
        for site, fields in built_in_sites().items()
        for field, rules in fields.items()
        if site != "flipkart"
    ]
    table = config.convert_sites(spark.createDataFrame(old, "site string, key string, selectors array<string>"))
    rows = extract_rows(market_pages(spark, sf_dir), table, ("current_price",))
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("containers"), F.count("current_price").alias("priced")
    )


@query(
    "template_merge",
    _with(
        """select page_id, "index", case when k % 11 <> 0 then p_name end as name,
 case when k % 13 <> 0 then '₹' || price end as current_price from market where site = 'meesho'""",
        base=MARKET,
    ),
)
def template_merge(spark, sf_dir):
    """Meesho pages with a proposed container and name; the generic template fills in the price."""
    schema = "site string, field string, type string, selectors array<string>"
    proposed = spark.createDataFrame(
        [
            ("meesho", "product_container", "css", ["div.product"]),
            ("meesho", "name", "css", [".//h3"]),
            ("meesho", "rating", "css", []),
        ],
        schema,
    )
    templates = config.nested_form(config.selector_table(spark, platform_templates()))
    labels = spark.createDataFrame([("meesho", "generic")], "site string, platform string")
    table, _ = config.merge_with_templates(proposed, templates, labels, ("product_container", "name", "current_price"))
    rows = extract_rows(market_pages(spark, sf_dir), table, ("name", "current_price"))
    return rows.select("page_id", "index", "name", "current_price")


@query(
    "json_proposals",
    _with("""select page_id, "index", case when k % 6 <> 0 then p_name end as name,
 case when k % 5 = 0 then null when k % 17 = 0 then '9.9 out of 5'
  else (k % 50) // 10 || '.' || k % 10 || ' out of 5' end as rating from cards"""),
)
def json_proposals(spark, sf_dir):
    texts = spark.createDataFrame(
        [
            (s, '{"selectors": {"product_container": {"selectors": ["div.product"]}, '
             '"name": {"selector_type": "xpath", "selectors": [".//img[1]/@alt", ".//img[1]/@alt"]}}}')
            for s in SHOPS
        ],
        "site string, proposal string",
    )
    hints = config.from_hints(
        field_hints(spark).groupBy("field").agg(F.collect_list("hint").alias("hints"))
    )
    shops = F.explode(F.array(*[F.lit(s) for s in SHOPS])).alias("site")
    per_site = hints.filter("field = 'rating'").select(shops, "*")
    adopted = config.adopt_proposals(config.from_json_proposals(texts, per_site))
    # Hints say css whatever they are; a path is run as one, as when merging with templates.
    kind = F.when(F.col("selector").startswith(".//"), "xpath").otherwise(F.col("type")).alias("type")
    table = adopted.select("*", F.posexplode("selectors").alias("rank", "selector")).select(
        "site", "field", kind, "rank", "selector",
        F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("regex"),
    )
    rows = extract_rows(listing_pages(spark, sf_dir), table, ("name", "rating"))
    return rows.select("page_id", "index", "name", "rating")


# -- gated runs -----------------------------------------------------------------------------------

RATES = """site_rates as (select site, sum(valid)::bigint * 100.0::double / (max(total) * 9) as rate from perf group by site)"""


@query(
    "quality_gate",
    _with(
        """select p.site, p.page_id, p."index", round(rate, 6) as overall_success_rate, rate < 57.5 as below_threshold
 from products p join site_rates using (site)""",
        LONG,
        PERF,
        RATES,
    ),
)
def quality_gate(spark, sf_dir):
    judged = workflow.gate(stored_products(spark, sf_dir), 57.5)
    return judged.select(
        "site", "page_id", "index", F.round("overall_success_rate", 6).alias("overall_success_rate"), "below_threshold"
    )


CANDIDATES = {
    "name": css("h2 span", "a[title]", "img[alt]"),
    "current_price": (Rule("del"), Rule("span.price"), Rule("span.stock")),
}


@query(
    "candidate_selectors",
    _with(
        """select site, field, candidate, selector, total, valid,
 cast(row_number() over (partition by site, field order by valid desc, candidate) as integer) as rank from (
 select site, field, candidate, selector, count(*) as total, count(case when hit then 1 end) as valid from cards
 cross join lateral (values ('name', 0, 'h2 span', k % 11 <> 0), ('name', 1, 'a[title]', k % 11 <> 0),
  ('name', 2, 'img[alt]', false), ('current_price', 0, 'del', k % 2 = 0), ('current_price', 1, 'span.price', k % 13 <> 0),
  ('current_price', 2, 'span.stock', k % 9 = 0)) as v(field, candidate, selector, hit) group by all)"""
    ),
)
def candidate_selectors(spark, sf_dir):
    box = {s: {"product_container": css("div.product")} for s in SHOPS}
    return workflow.rank_candidates(listing_pages(spark, sf_dir), box, CANDIDATES)


@query(
    "improved_run",
    _with(
        """select page_id, "index", case when k % 11 <> 0 then p_name || ' #' || k end as name,
 case when k % 13 <> 0 then '₹' || price when k % 2 = 0 then '₹' || (price + 100) end as current_price,
 true as below_threshold, 3 as round from cards where k % 11 <> 0 or k % 13 <> 0 or k % 2 = 0"""
    ),
)
def improved_run(spark, sf_dir):
    """Starts from selectors that find little, improves twice, saves what stays below 80 percent."""
    poor = {
        s: {"product_container": css("div.product"), "name": css("h5"), "current_price": css("del")}
        for s in SHOPS
    }
    saved = workflow.run_workflow(
        listing_pages(spark, sf_dir), poor, CANDIDATES, new_folder(spark, "run")
    )
    return saved.select("page_id", "index", "name", "current_price", "below_threshold", "round")


@query(
    "run_report",
    _with(
        f"""select site, total_products, valid_values, round(overall_success_rate, 6) as overall_success_rate,
 round(score, 6) as score, {HEALTH_STATUS} as health, critical_fields, weak_fields from (
 select site, max(total) as total_products, sum(valid)::bigint as valid_values,
  sum(valid)::bigint * 100.0::double / (max(total) * 9) as overall_success_rate,
  avg(round(valid * 100.0::double / total, 1)) as score,
  count(*) filter (where round(valid * 100.0::double / total, 1) < 50) as critical_fields,
  count(*) filter (where round(valid * 100.0::double / total, 1) >= 50 and round(valid * 100.0::double / total, 1) < 80) as weak_fields
 from perf group by site)""",
        LONG,
        PERF,
    ),
)
def run_report(spark, sf_dir):
    report = workflow.run_report(stored_products(spark, sf_dir))
    return report.withColumns(
        {c: F.round(c, 6) for c in ("overall_success_rate", "score")}
    )


# -- streams --------------------------------------------------------------------------------------


def _when():
    return F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 600)


def _landed(spark, sf_dir, copies: bool = False):
    """Listing pages written as the files a stream reads; page n is scraped n times 10 minutes in."""
    rows = listing_pages(spark, sf_dir).select("page_id", "url", "html", "site", _when().alias("scraped_at"))
    if copies:
        rows = rows.unionByName(rows)
    path = new_folder(spark, "landed")
    rows.write.parquet(path)
    return continuous.landed_pages(spark, path)


@query(
    "stream_products",
    _with(
        f'select site, page_id, "index", {FIELD_LIST}, rate < 80 as below_threshold from products join site_rates using (site)',
        LONG,
        PERF,
        RATES,
    ),
)
def stream_products(spark, sf_dir):
    table = new_folder(spark, "stream")
    run = continuous.extract_stream(
        _landed(spark, sf_dir), SELECTORS, table, new_folder(spark, "progress")
    )
    run.awaitTermination()
    return continuous.gated_products(spark, table).select("site", "page_id", "index", *FIELDS, "below_threshold")


@query(
    "stream_first_copies",
    _with("select page_id, site from cards group by page_id, site"),
)
def stream_first_copies(spark, sf_dir):
    table = new_folder(spark, "copies")
    once = continuous.first_copies(_landed(spark, sf_dir, copies=True), "365 days")
    run = (
        once.select("page_id", "site")
        .writeStream.format("parquet")
        .option("checkpointLocation", new_folder(spark, "progress"))
        .trigger(availableNow=True)
        .start(table)
    )
    run.awaitTermination()
    return spark.read.schema("page_id bigint, site string").parquet(table)


@query(
    "rates_over_time",
    _with(
        """select strftime(timestamp '2024-01-01' + to_hours(page_id // 6), '%Y-%m-%d %H:00') as window_start, site, field,
 count(*) as total, count(value) as valid, count(value) * 100.0::double / count(*) as success_rate
 from long group by all""",
        LONG,
    ),
)
def rates_over_time(spark, sf_dir):
    """Hourly rates kept by a stream of product rows: the closed windows and those still open."""
    folder = _rates(spark, products(spark, sf_dir).withColumn("scraped_at", _when()))
    counts = continuous.closed_windows(spark, folder).unionByName(continuous.open_windows(spark, folder))
    rates = continuous.field_rates(counts)
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:00"))


#: How many landings a stream of product rows is dealt into: a batch each, however many rows there are.
LANDINGS = 8


def _rates(spark, found):
    """Land product rows in the order of their times and keep their rates: a run of the stream, on from the one before, takes each
    landing as one batch. All tasks write and read a landing, so it may grow with the rows; the number of batches does not."""
    path, folder, progress = (new_folder(spark, purpose) for purpose in ("rows", "rates", "progress"))
    for part in _landings(found):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(found.schema).parquet(path)
        continuous.rates_stream(stream, folder, progress).awaitTermination()
    return folder


def _landings(found, n: int = LANDINGS):
    """The rows in `n` parts of about equal size, or fewer: no time of a part is later than one of the next."""
    spark, rows = found.sparkSession, cut(found, "found")
    bounds = rows.agg(F.percentile_approx("scraped_at", [i / n for i in range(1, n)]).alias("b")).first().b or []
    after = [F.when(F.col("scraped_at") > F.lit(b), 1).otherwise(0) for b in sorted(set(bounds))]
    landing = sum(after, F.lit(0))
    dealt = cut(rows.withColumn("landing", landing), "landings", by=("landing",))
    return [dealt.where(F.col("landing") == i).drop("landing") for i in range(len(after) + 1)]


@query(
    "page_visits",
    """with landed as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n, event_type,
  ts - lag(ts) over (partition by user_id order by ts, event_id) as gap from (select *, event_id as e from events)),
 starts as (select *, sum(case when gap is null or gap >= interval 6 hours then 1 else 0 end) over (partition by user_id order by n) as visit from landed)
 select 'https://example.com/u/' || user_id as url, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen, count(*) as landings, arg_min(event_type, n) <> arg_max(event_type, n) as changed
 from starts group by user_id, visit""",
)
def page_visits(spark, sf_dir):
    """Landings with the times of `events`, one address a user, as visits with gaps under six hours."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("https://example.com/u/"), "user_id").alias("url"), F.col("event_type").alias("html"), F.col("ts").alias("scraped_at")
    )
    found = continuous.visits(rows, "6 hours")
    seen = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")}
    return found.withColumns(seen)
