"""Selector configurations as tables: build, convert, check, merge and propose."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators.extract import Config, Rule
from pagequarry.schema import CONFIG_FIELDS, SELECTOR_TYPES, SELECTORS_SCHEMA

# Keys of the older site form and the fields they set.
OLD_KEYS = {
    "product_selector": "product_container",
    "name_selectors": "name",
    "price_selectors": "current_price",
    "original_price_selectors": "original_price",
    "rating_selectors": "rating",
    "reviews_selectors": "reviews",
    "discount_selectors": "discount",
    "offers_selectors": "offers",
}

# Fields a merged configuration must cover, and list lengths of proposals.
REQUIRED = (
    "product_container",
    "name",
    "current_price",
    "original_price",
    "rating",
    "reviews",
    "discount",
)
HINTS_KEPT, PROPOSALS_KEPT = 2, 3
DEFAULT_OFFERS = ('div[class*="offer"]', 'span[class*="coupon"]')

_KEYS = ("site", "field")


def selector_table(spark: SparkSession, configs: Mapping[str, Config]) -> DataFrame:
    """Configurations in code to a selector table."""
    rows = [
        (site, field, r.type, rank, r.selector, r.attribute, r.regex)
        for site, config in configs.items()
        for field, rules in config.items()
        for rank, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, SELECTORS_SCHEMA)


def create_selector_config(
    product_container: list[str], name: list[str], current_price: list[str], **optional: list[str] | None
) -> dict[str, tuple[Rule, ...]]:
    """Three required css lists and any optional ones; empty optional lists are left out."""
    lists = {"product_container": product_container, "name": name, "current_price": current_price}
    lists.update({f: v for f, v in optional.items() if v})
    return {field: tuple(Rule(s) for s in selectors) for field, selectors in lists.items()}


def convert_sites(old: DataFrame) -> DataFrame:
    """Older form (site, key, selectors array) to a selector table. Unknown keys are dropped, a site
    without container gets `div`."""
    names = F.create_map(*[F.lit(x) for pair in OLD_KEYS.items() for x in pair])
    known = old.withColumn("field", names[F.col("key")]).filter("field is not null")
    has_box = known.filter("field = 'product_container'").select("site").distinct()
    default = old.select("site").distinct().join(has_box, "site", "left_anti").select(
        "site", F.lit("product_container").alias("field"), F.array(F.lit("div")).alias("selectors")
    )
    return _ranked(known.select("site", "field", "selectors").unionByName(default), F.lit("css"))


def _ranked(rows: DataFrame, type_: Column) -> DataFrame:
    """(site, field, selectors array) to one row per selector with its rank."""
    return rows.select("*", F.posexplode("selectors").alias("rank", "selector")).select(
        "site",
        "field",
        type_.alias("type"),
        "rank",
        "selector",
        F.lit(None).cast("string").alias("attribute"),
        F.lit(None).cast("string").alias("regex"),
    )


def check_proposals(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, field, type, selectors array) split into valid rows and rejected ones with the reason."""
    reason = (
        F.when(~F.col("field").isin(*CONFIG_FIELDS), F.concat(F.lit("Invalid field '"), "field", F.lit("'")))
        .when(~F.col("type").isin(*SELECTOR_TYPES), F.concat(F.lit("Invalid selector type '"), "type", F.lit("'")))
        .when(
            F.coalesce(F.size("selectors"), F.lit(0)) <= 0,
            "Selectors must be a non-empty list of strings",
        )
    )
    judged = proposals.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def upsert_selectors(current: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with each validly proposed (site, field) replaced, and the rejected proposals."""
    valid, rejected = check_proposals(proposals)
    kept = current.join(valid.select(*_KEYS), list(_KEYS), "left_anti").select(*current.columns)
    return kept.unionByName(_ranked(valid, F.col("type"))), rejected


def available_fields(selectors: DataFrame) -> DataFrame:
    """Every settable field with its description and how many selectors each site has for it."""
    named = F.create_map(*[F.lit(x) for pair in CONFIG_FIELDS.items() for x in pair])
    counts = selectors.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("selectors"))
    every = selectors.select("site").distinct().select(
        "site", F.explode(named).alias("field", "description")
    )
    return every.join(counts, list(_KEYS), "left").withColumn(
        "selectors", F.coalesce("selectors", F.lit(0))
    )


def nested_form(selectors: DataFrame) -> DataFrame:
    """Selector table to (site, field, type, selectors array)."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "selector")))
    return selectors.groupBy(*_KEYS).agg(
        F.min_by("type", "rank").alias("type"),
        F.transform(listed, lambda x: x["selector"]).alias("selectors"),
    )


def merge_with_templates(
    proposed: DataFrame, templates: DataFrame, platforms: DataFrame, targets: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Proposals win, the template of a site's platform fills required fields without selectors.

    proposed: (site, field, type, selectors); templates: the same keyed by platform in `site`;
    platforms: (site, platform). css lists with an xpath in them become xpath; fields outside
    `targets` (if given) are dropped; sites left without container are returned as errors.
    """
    usable = proposed.filter(F.coalesce(F.size("selectors"), F.lit(0)) > 0)
    fill = (
        platforms.join(templates.withColumnRenamed("site", "platform"), "platform")
        .filter(F.col("field").isin(*REQUIRED))
        .select("site", "field", F.col("type").alias("t_type"), F.col("selectors").alias("t_selectors"))
    )
    merged = usable.join(fill, list(_KEYS), "full").select(
        *_KEYS,
        F.lower(F.coalesce("type", "t_type", F.lit("css"))).alias("type"),
        F.coalesce("selectors", "t_selectors").alias("selectors"),
    )
    boxed = merged.filter("field = 'product_container'").select("site")
    errors = platforms.select("site").join(boxed, "site", "left_anti").withColumn(
        "error", F.lit("No product_container selectors available")
    )
    is_path = F.exists("selectors", lambda s: F.trim(s).startswith("//") | F.trim(s).startswith(".//"))
    ready = merged.join(boxed, "site", "left_semi").withColumn(
        "type", F.when((F.col("type") == "css") & is_path, "xpath").otherwise(F.col("type"))
    )
    if targets:
        ready = ready.filter(F.col("field").isin(*targets))
    return _ranked(ready, F.col("type")), errors


def from_hints(hints: DataFrame) -> DataFrame:
    """(field, hints array of strings) to (field, type, selectors): repeats dropped, first two kept."""
    usable = F.filter("hints", lambda h: h.isNotNull() & (h != ""))
    return hints.select(
        "field",
        F.lit("css").alias("type"),
        F.slice(F.array_distinct(usable), 1, HINTS_KEPT).alias("selectors"),
    ).filter(F.size("selectors") > 0)


PROPOSAL_JSON = (
    "selectors map<string, struct<selector_type: string, type: string, selectors: array<string>>>"
)


def from_json_proposals(texts: DataFrame, hints: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """JSON proposals (keys, proposal) overlaid on hints (keys, field, type, selectors): a proposed
    field replaces the hinted one; repeats are dropped and the first three kept."""
    parsed = texts.select(*keys, F.from_json("proposal", PROPOSAL_JSON)["selectors"].alias("s"))
    each = parsed.select(*keys, F.explode("s").alias("field", "cfg"))
    usable = F.filter("cfg.selectors", lambda s: s.isNotNull() & (s != ""))
    proposed = each.select(
        *keys,
        "field",
        F.coalesce("cfg.selector_type", "cfg.type", F.lit("css")).alias("type"),
        F.slice(F.array_distinct(usable), 1, PROPOSALS_KEPT).alias("selectors"),
    ).filter(F.size("selectors") > 0)
    kept = hints.join(proposed.select(*keys, "field"), [*keys, "field"], "left_anti")
    return kept.select(*proposed.columns).unionByName(proposed)


def adopt_proposals(proposed: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Proposals of sites that name both a container and a name field, with default offers added."""
    window = Window.partitionBy(*keys)

    def has(field):
        return F.max(F.col("field") == field).over(window)

    complete = proposed.withColumn("ok", has("product_container") & has("name")).filter("ok").drop("ok")
    offers = F.array(*[F.lit(s) for s in DEFAULT_OFFERS])
    lacking = complete.groupBy(*keys).agg(F.max(F.col("field") == "offers").alias("has"))
    default = lacking.filter("not has").select(
        *keys, F.lit("offers").alias("field"), F.lit("css").alias("type"), offers.alias("selectors")
    )
    return complete.filter(F.col("field").isin(*CONFIG_FIELDS)).unionByName(default)
