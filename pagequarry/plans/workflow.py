"""End-to-end runs: extract, judge, improve, gate, save, report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators import quality
from pagequarry.operators.extract import Config, Rule, extract_products, extract_rows, parse_once
from pagequarry.schema import FIELDS
from pagequarry.sources.sinks import append_products, stored_products, write_csv
from pagequarry.sources.storage import cut

# The overall rate that lets rows through, and how often a run is retried.
THRESHOLD, ROUNDS = 80.0, 3


def scrape(pages: DataFrame, configs: Mapping[str, Config], csv_path: str) -> DataFrame:
    """Extract, store as CSV, and count per site. Extraction runs once."""
    products = cut(extract_products(pages, configs), "products")
    write_csv(stored_products(products), csv_path)
    return quality.scrape_counts(products)


def scrape_and_append(pages: DataFrame, configs: Mapping[str, Config], table_path: str, run: str | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """Extract and append to a table; the outcome row. A named run may be repeated. `parsed`: see `parse_once`."""
    return append_products(extract_products(pages, configs, parsed=parsed), table_path, run=run)


def gate(products: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Product rows with their site's overall rate and whether it is below the threshold. There is one
    rate per site, so the join is small against the rows and no row moves if it is broadcast."""
    rates = quality.site_performance(products).select("site", "overall_success_rate")
    return products.join(rates, "site").withColumn(
        "below_threshold", F.col("overall_success_rate") < threshold
    )


def split_by_gate(products: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows of passing sites, and quarantined rows with the reason."""
    judged = gate(products, threshold)
    held = judged.filter("below_threshold").withColumn(
        "reason",
        F.format_string(f"overall success rate %.1f%% is below {threshold:g}%%", "overall_success_rate"),
    )
    return judged.filter(~F.col("below_threshold")).drop("below_threshold"), held.drop("below_threshold")


def _trial(candidates: Mapping[str, tuple[Rule, ...]]) -> tuple[dict[str, tuple[Rule, ...]], dict[str, tuple[str, int, str]]]:
    """Every candidate as a field of its own, and which field, place and selector it stands for."""
    trial, names = {}, {}
    for field, rules in candidates.items():
        for i, rule in enumerate(rules):
            name = f"candidate {len(names)}"
            names[name] = (field, i, rule.selector)
            trial[name] = (rule,)
    return trial, names


def rank_candidates(
    pages: DataFrame, configs: Mapping[str, Config], candidates: Mapping[str, tuple[Rule, ...]], parsed: DataFrame | None = None
) -> DataFrame:
    """Every candidate selector of every field tried in one extraction: per site, field and candidate
    the number of containers it gives a value for, best first."""
    trial, names = _trial(candidates)
    tried = {
        site: {**trial, **({"product_container": c["product_container"]} if "product_container" in c else {})}
        for site, c in configs.items()
    }
    rows = extract_rows(pages, tried, tuple(names), parsed=parsed)
    counts = rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(quality.has_value(F.col(n))).alias(n) for n in names],
    )
    long = counts.unpivot(["site", "total"], list(names), "name", "valid")
    tries = F.create_map(
        *[
            x
            for name, (field, i, selector) in names.items()
            for x in (F.lit(name), F.struct(F.lit(field).alias("field"), F.lit(i).alias("candidate"), F.lit(selector).alias("selector")))
        ]
    )
    tried_as = tries[F.col("name")]
    ranked = long.select(
        "site",
        tried_as["field"].alias("field"),
        tried_as["candidate"].alias("candidate"),
        tried_as["selector"].alias("selector"),
        "total",
        "valid",
    )
    order = Window.partitionBy("site", "field").orderBy(F.desc("valid"), "candidate")
    return ranked.withColumn("rank", F.row_number().over(order))


def improve(
    pages: DataFrame,
    configs: Mapping[str, Config],
    candidates: Mapping[str, tuple[Rule, ...]],
    failing: Mapping[str, list[str]],
    parsed: DataFrame | None = None,
) -> dict[str, Config]:
    """Configurations of failing sites with the best candidate of each failing field put first."""
    sites = {s: configs[s] for s in failing if failing[s]}
    fields = {f for names in failing.values() for f in names if f in candidates}
    if not sites or not fields:
        return dict(configs)
    trial = rank_candidates(pages, sites, {f: candidates[f] for f in candidates if f in fields}, parsed)
    best = trial.filter("rank = 1 and valid > 0").select("site", "field", "candidate")
    improved = dict(configs)
    # One row per configured site and field: as large as the configuration, not the data.
    for row in best.collect():
        if row.field in failing.get(row.site, ()):
            rule = candidates[row.field][row.candidate]
            rest = tuple(r for r in improved[row.site].get(row.field, ()) if r != rule)
            improved[row.site] = {**improved[row.site], row.field: (rule, *rest)}
    return improved


def run_workflow(
    pages: DataFrame,
    configs: Mapping[str, Config],
    candidates: Mapping[str, tuple[Rule, ...]],
    table_path: str,
    threshold: float = THRESHOLD,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Extract sites, save those that pass, improve the selectors of the others and try again; after
    the last round the rest is saved too, marked below_threshold. Returns the saved table, which belongs
    to this run: each round writes its own part and replaces it when it is run again.

    The pages are parsed once, into the shared folder; every round and every trial reads that. The driver sees one rate per
    configured site and field. Sites must be named in `configs`.
    """
    configs = dict(configs)
    pending = list(configs)
    spark = pages.sparkSession
    trial, names = _trial(candidates)
    all_pages = pages.filter(F.col("site").isin(pending))
    all_parsed = cut(parse_once(all_pages, (configs, FIELDS), ({s: trial for s in configs}, tuple(names))), "parsed")
    for number in range(1, rounds + 1):
        some, parsed = (rows.filter(F.col("site").isin(pending)) for rows in (all_pages, all_parsed))
        products = cut(extract_products(some, {s: configs[s] for s in pending}, parsed=parsed), "round")
        rates = {r.site: r.overall_success_rate for r in quality.site_performance(products).collect()}
        passed = [s for s in pending if rates.get(s, 0.0) >= threshold]
        saved = pending if number == rounds else passed
        if saved:
            rows = gate(products.filter(F.col("site").isin(saved)), threshold)
            rows.write.mode("overwrite").parquet(f"{table_path}/round={number}")
        pending = [s for s in pending if s not in saved]
        if not pending:
            break
        poor = quality.field_performance(products.filter(F.col("site").isin(pending)))
        failing: dict[str, list[str]] = {s: [] if s in rates else list(candidates) for s in pending}
        for row in poor.filter("status <> 'GOOD'").select("site", "field").collect():
            failing[row.site].append(row.field)
        mine = F.col("site").isin(pending)
        configs = improve(some.filter(mine), configs, candidates, failing, parsed.filter(mine))
    return spark.read.parquet(table_path)


def run_report(products: DataFrame) -> DataFrame:
    """One row per site: products, overall rate, health, and how many fields need which attention."""
    per_field = quality.field_performance(products)
    health = quality.health_report(per_field).select(
        "site",
        "score",
        F.col("status").alias("health"),
        F.size("critical_issues").alias("critical_fields"),
        F.size("recommendations").alias("weak_fields"),
    )
    return quality.site_performance(products).join(health, "site", "left")
