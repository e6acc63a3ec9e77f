"""Site-specific extraction: text-only fallbacks, name and price chains, multi-valued offers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.text import regex_value, strip
from pagequarry.operators.extract import Config, Rule, css, extract_rows
from pagequarry.sources.parse import node_text

# Containers tried after a site's own selector.
FALLBACK_BOXES = {
    "flipkart": (
        'div[class*="_4WELSP"]',
        'div[class*="slAVV4"]',
        'div[class*="hl05eU"]',
        'div[class*="DMMoT0"]',
        'a[href*="/p/"]',
        "div[data-id]",
    ),
    "*": (
        'div[class*="product"]',
        'div[class*="item"]',
        'div[class*="card"]',
        "div[data-id]",
        'div[class*="search"]',
    ),
}

# Per site the shortest accepted name and a prefix no name may start with.
NAME_RULES = (
    ("amazon", 10, None),
    ("flipkart", 5, None),
    ("sathya", 2, "₹"),
    ("meesho", 3, None),
)

# Where delivery and availability are looked for, same for all sites.
DELIVERY = (
    *css('div[class*="delivery"]', 'span[class*="delivery"]', 'div[class*="shipping"]'),
    Rule("delivery|shipping", "string"),
)
AVAILABILITY = (
    *css('span[class*="stock"]', 'div[class*="availability"]'),
    Rule("bought|stock|available", "string"),
)

# List-price patterns over an item's whole text, in order.
MRP_PATTERNS = (
    r"MRP[:\s]*₹?([\d,]+)",
    r"M\.R\.P[:\s]*₹?([\d,]+)",
    r"₹([\d,]+)\s*\(MRP\)",
    r"₹([\d,]+)\s*\(M\.R\.P\)",
)

PLAIN_FIELDS = ("name", "current_price", "original_price", "rating", "reviews", "discount")

# First hits the two name chains and the list price choose from.
SATHYA = {
    "s_alt": (Rule("img", "find", attribute="alt"),),
    "s_href": (Rule("a[href]", "find", attribute="href"),),
    "s_h4": (Rule("div.product-detail >> h4", "find"),),
    "s_h3": (Rule("div.product-detail >> h3", "find"),),
    "s_h2": (Rule("div.product-detail >> h2", "find"),),
    "s_mrp": css('span:contains("MRP")'),
}
FLIPKART = {
    "f_img": (Rule('img[class*="DByuf4"]', "find", attribute="alt"),),
    "f_title": (Rule('a[class*="wjcEIp"]', "find", attribute="title"),),
    "f_text": (Rule('a[class*="wjcEIp"]', "find"),),
    "f_ptitle": (Rule('a[href*="/p/"]', "find", attribute="title"),),
    "f_ptext": (Rule('a[href*="/p/"]', "find"),),
    "f_any": (Rule("img", "find", attribute="alt"),),
}


def with_fallback_boxes(configs: Mapping[str, Config]) -> dict[str, Config]:
    """Each site's own container selector, then the fallbacks."""
    return {
        site: {
            **config,
            "product_container": (
                *config["product_container"],
                *css(*FALLBACK_BOXES.get(site, FALLBACK_BOXES["*"])),
            ),
        }
        for site, config in configs.items()
    }


def _text_only(configs: Mapping[str, Config]) -> dict[str, Config]:
    """Selectors without attribute and regex, which these sites ignore."""
    return {
        site: {f: tuple(Rule(r.selector) for r in rules) for f, rules in config.items()}
        for site, config in configs.items()
    }


def _longer(value: Column, size: int, *prefixes: str) -> Column:
    ok = F.length(value) > size
    for prefix in prefixes:
        ok = ok & ~value.startswith(prefix)
    return F.when(ok, value)


def title_case(text: Column) -> Column:
    """Blank-separated words capitalised; digits and apostrophes do not start a new word."""
    return F.initcap(text)


def sathya_name() -> Column:
    """Image text, else the last part of a category link, else a detail heading, else a text line."""
    slug = F.try_element_at(F.split("s_href", "/"), F.lit(-1))
    from_link = F.when(F.contains(F.col("s_href"), F.lit("/category/")), title_case(F.replace(slug, F.lit("-"), F.lit(" "))))
    heading = F.coalesce("s_h4", "s_h3", "s_h2")
    return F.coalesce(
        _longer(F.col("s_alt"), 5, "₹"),
        _longer(from_link, 3),
        _longer(heading, 5, "₹"),
        F.col("s_line"),
    )


def first_line() -> Column:
    """First usable line of an item's text, for items with more than ten characters of it."""
    text = node_text("stripped")
    usable = F.filter(
        F.transform(F.split(text, "\n"), strip),
        lambda x: (F.length(x) > 5) & ~x.startswith("₹") & ~x.startswith("(") & ~x.startswith("Save"),
    )
    return F.when(F.length(text) > 10, F.try_element_at(usable, F.lit(1)))


def flipkart_name() -> Column:
    names = ("f_img", "f_title", "f_text", "f_ptitle", "f_ptext", "f_any")
    return F.coalesce(*[_longer(F.col(n), 5) for n in names])


def mrp_price() -> Column:
    near = regex_value(F.col("s_mrp"), r"₹([\d,]+)", ignore_case=False)
    return F.concat(F.lit("₹"), F.coalesce(near, F.col("s_mrp_text")))


def name_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAME_RULES, "site string, min_len int, reject_prefix string")


def valid_names(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with a name that is long enough for its site and does not start like a price. `rules` has
    one row per site with rules (a handful) and is broadcast: a shuffle by site would put all rows of a site into one
    task. Other sites only need a name."""
    checked = rows.filter(F.col("name").isNotNull()).join(F.broadcast(rules), "site", "left")
    fits = F.length("name") >= F.coalesce("min_len", F.lit(1))
    priced = F.coalesce(F.col("name").startswith(F.col("reject_prefix")), F.lit(False))
    return checked.filter(fits & ~priced).drop("min_len", "reject_prefix")


def extract_site_rows(pages: DataFrame, configs: Mapping[str, Config], partitions: int | None = None) -> DataFrame:
    """Product rows of the configured sites before name checks; offers stay an array, out of the same pass."""
    configs = _text_only(configs)
    boxed = with_fallback_boxes(configs)
    special = {"sathya": SATHYA, "flipkart": FLIPKART}
    everything = {
        site: {**config, "delivery": DELIVERY, "availability": AVAILABILITY} for site, config in boxed.items()
    }
    fields = (*PLAIN_FIELDS, "delivery", "availability")
    chain_fields = tuple(f for site, chain in special.items() if site in configs for f in chain)
    for site, chain in special.items():
        if site in everything:
            everything[site] = {**everything[site], **chain}
    text = node_text("stripped")
    box_values = {}
    if "sathya" in configs:
        box_values = {
            "s_line": F.when(F.col("site") == "sathya", first_line()),
            "s_mrp_text": F.when(
                F.col("site") == "sathya", F.coalesce(*[regex_value(text, p) for p in MRP_PATTERNS])
            ),
        }
    rows = extract_rows(
        pages, everything, (*fields, *chain_fields), cleaning="strip", box_values=box_values, listed="offers", partitions=partitions
    )
    name, original = F.col("name"), F.col("original_price")
    site = F.col("site")
    if "sathya" in configs:
        name = F.when(site == "sathya", sathya_name()).otherwise(name)
        original = F.when(site == "sathya", mrp_price()).otherwise(original)
    if "flipkart" in configs:
        name = F.when(site == "flipkart", flipkart_name()).otherwise(name)
    # The chains are long: coming out of a generator they are computed once, and a later filter on the
    # name is not unfolded into them.
    chained = F.inline(F.array(F.struct(name.alias("name"), original.alias("original_price"))))
    skip = ("name", "original_price", *chain_fields, *box_values)
    return rows.select(*[c for c in rows.columns if c not in skip], chained)


def extract_site_products(pages: DataFrame, configs: Mapping[str, Config], partitions: int | None = None) -> DataFrame:
    rows = extract_site_rows(pages, configs, partitions)
    return valid_names(rows, name_rules(pages.sparkSession)).drop("box_id")
