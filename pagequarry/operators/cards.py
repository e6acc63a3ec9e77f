"""Listing cards: containers found by several strategies at once, then one card row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.arrays import group_runs
from pagequarry.operators.extract import ANY_SITE, Rule, extract_rows
from pagequarry.operators.selectors import HOLDS, Path, Test, compile_css
from pagequarry.schema import CARD_COLUMNS

# Card selectors, links and price blocks whose closest div counts as a card, and the
# marks of an element that looks like one.
BOXES = ('div[class*="_4WELSP"]', 'div[class*="slAVV4"]', 'div[class*="hl05eU"]')
LINK, PRICE_BLOCK, PRICE = 'a[href*="/p/"]', 'div[class*="hl05eU"]', 'div[class*="Nx9bqj"]'
MARKS = ("_4WELSP", "slAVV4", "hl05eU", "DMMoT0", "wjcEIp")

RULES = {
    "t1_title": (Rule('a[class*="wjcEIp"]', "find", attribute="title"),),
    "t1_text": (Rule('a[class*="wjcEIp"]', "find"),),
    "t1_href": (Rule('a[class*="wjcEIp"]', "find", attribute="href"),),
    "t2_title": (Rule('a[href*="/p/"]', "find", attribute="title"),),
    "t2_text": (Rule('a[href*="/p/"]', "find"),),
    "t2_href": (Rule('a[href*="/p/"]', "find", attribute="href"),),
    "i1_tag": (Rule('img[class*="DByuf4"]', "find"),),
    "i1_src": (Rule('img[class*="DByuf4"]', "find", attribute="src"),),
    "i1_alt": (Rule('img[class*="DByuf4"]', "find", attribute="alt"),),
    "i2_src": (Rule('img[src*="rukminim2.flixcart.com"]', "find", attribute="src"),),
    "i2_alt": (Rule('img[src*="rukminim2.flixcart.com"]', "find", attribute="alt"),),
    "current_price": (Rule('div[class*="hl05eU"] >> div[class*="Nx9bqj"]', "find"),),
    "original_price": (Rule('div[class*="hl05eU"] >> div[class*="yRaY8j"]', "find"),),
    "discount": (Rule('div[class*="hl05eU"] >> div[class*="UkUFwK"] >> span', "find"),),
    "rating_text": (
        Rule(
            'div[class*="_5OesEi"][class*="afFzxY"] >> span[class*="Y1HWO0"] >> div[class*="XQDdHH"]',
            "find",
        ),
    ),
    "rating_count": (
        Rule('div[class*="_5OesEi"][class*="afFzxY"] >> span[class*="Wphh3N"]', "find"),
    ),
    "wishlist": (Rule('div[class*="+7E521"]', "find"),),
}


def _step(css: str) -> Test:
    return compile_css(css).paths[0].steps[0]


def _is(node: Column, css: str) -> Column:
    """Does a node of the array pass a selector of a tag and one part of an attribute?"""
    test = _step(css)
    (_, name, part), = test.attrs
    return F.coalesce((node["tag"] == test.tag) & F.contains(node["attrs"][name], F.lit(part)), F.lit(False))


def with_boxes(parsed: DataFrame) -> DataFrame:
    """Adds `box_ids`, the union of all strategies in strategy then document order, and `positions`, the place of each.

    A card selector's hits always count. The closest div around a link or price block counts unless
    an earlier container has the very same source text, which the parse has named by the first element with it.
    All votes of a page are sorted in its own row: by element, by content, then by strategy.
    """

    def vote(test: Column, target: Column, strategy: Column, voter: Column) -> Column:
        entry = F.struct(target.alias("target"), strategy.alias("strategy"), voter.alias("voter"))
        return F.when(test & target.isNotNull() & strategy.isNotNull(), entry)

    def votes(n: Column) -> Column:
        by_selector = F.lit(None).cast("int")
        for i, css in reversed(list(enumerate(BOXES))):
            by_selector = F.when(_is(n, css), F.lit(i)).otherwise(by_selector)
        here = n["node_id"]
        return F.array(
            vote(F.lit(True), here, by_selector, here),
            vote(_is(n, LINK), n["near_id"], F.lit(3), here),
            vote(_is(n, PRICE_BLOCK), n["near_id"], F.lit(4), here),
        )

    cast = F.filter(F.flatten(F.transform("nodes", votes)), lambda v: v.isNotNull())
    rows = group_runs(parsed.withColumn("votes", F.array_sort(cast)), "votes", "target", "voted")
    won = F.transform("voted", lambda g: F.get(F.col("votes"), g["at"]))
    rows = rows.withColumn("won", won)
    contents = F.transform(
        "won",
        lambda w: F.struct(
            F.get(F.col("nodes"), w["target"])["same_id"].alias("content"),
            w["strategy"].alias("strategy"),
            w["voter"].alias("voter"),
            w["target"].alias("target"),
        ),
    )
    rows = group_runs(rows.withColumn("contents", F.array_sort(contents)), "contents", "content", "alike")
    marked = F.flatten(
        F.transform(
            "alike",
            lambda g: F.transform(
                F.sequence(F.lit(0), g["count"] - 1), lambda j: F.struct(F.get(F.col("contents"), g["at"] + j).alias("c"), (j == 0).alias("first"))
            ),
        )
    )
    kept = F.transform(
        F.filter(marked, lambda m: (m["c"]["strategy"] < 3) | m["first"]),
        lambda m: F.struct(m["c"]["strategy"].alias("strategy"), m["c"]["voter"].alias("voter"), m["c"]["target"].alias("id")),
    )
    rows = rows.withColumn("boxes", F.array_sort(kept))
    rows = rows.withColumns(
        {
            "box_ids": F.transform("boxes", lambda b: b["id"]),
            "positions": F.map_from_entries(F.transform("boxes", lambda b, i: F.struct(b["id"].alias("id"), (i + 1).alias("position")))),
        }
    )
    return rows.drop("votes", "voted", "won", "contents", "alike", "boxes")


def card_like() -> tuple[Path, ...]:
    """Divs with a card mark in their class, a product link or a price inside: for pages where no strategy finds a container."""
    any_div = Test(tag="div")
    marked = [Path((Test(tag="div", attrs=(("*=", "class", mark),)),)) for mark in MARKS]
    return (*marked, *[Path((_step(css), any_div), (HOLDS,)) for css in (LINK, PRICE)])


def looks_like_card(pages: DataFrame) -> DataFrame:
    """(page_id, node_id, position) of the containers that `cards` falls back to."""
    none = F.array().cast("array<int>")
    found = extract_rows(
        pages.select("page_id", "html"), {ANY_SITE: {}}, (), picked="box_ids", prepare=lambda p: p.withColumn("box_ids", none), otherwise=card_like()
    )
    return found.select("page_id", F.col("box_id").alias("node_id"), F.col("index").alias("position"))


def cards(pages: DataFrame) -> DataFrame:
    """One row per card with a title, price, image or link; product_id keeps the container position."""
    found = extract_rows(
        pages.select("page_id", "html"),
        {ANY_SITE: RULES},
        tuple(RULES),
        cleaning="raw",
        picked="box_ids",
        box_values={"position": F.element_at("positions", F.col("node_id"))},
        prepare=with_boxes,
        parse={"nearest": "div", "same": "div", "whole": True},
        otherwise=card_like(),
    )

    def text(*columns: Column | str) -> Column:
        return F.nullif(F.coalesce(*columns), F.lit(""))

    titled = F.col("t1_text").isNotNull()
    imaged = F.col("i1_tag").isNotNull()
    link_title = F.when(titled, text(F.nullif("t1_title", F.lit("")), "t1_text")).otherwise(
        text(F.nullif("t2_title", F.lit("")), "t2_text")
    )
    number = F.regexp_extract("rating_text", r"(\d+\.?\d*)", 1)
    rows = found.select(
        "page_id",
        F.coalesce("position", "index").alias("position"),
        F.coalesce(link_title, text(F.when(imaged, F.col("i1_alt")).otherwise(F.col("i2_alt")))).alias("title"),
        text("current_price").alias("current_price"),
        text("original_price").alias("original_price"),
        text("discount").alias("discount"),
        F.nullif(number, F.lit("")).alias("rating"),
        text("rating_count").alias("rating_count"),
        text(F.when(imaged, F.col("i1_src")).otherwise(F.col("i2_src"))).alias("image_url"),
        text(F.when(titled, F.col("t1_href")).otherwise(F.col("t2_href"))).alias("product_url"),
        F.col("wishlist").isNotNull().alias("wishlist_available"),
    )
    meaningful = F.coalesce("title", "current_price", "image_url", "product_url").isNotNull()
    return rows.filter(meaningful).withColumn(
        "product_id", F.concat(F.lit("product_"), F.col("position"))
    ).select("page_id", *CARD_COLUMNS)


def card_counts(rows: DataFrame) -> DataFrame:
    """Cards, and cards with a title, price, image and rating."""
    return rows.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count("title").alias("with_titles"),
        F.count("current_price").alias("with_prices"),
        F.count("image_url").alias("with_images"),
        F.count("rating").alias("with_ratings"),
    )
