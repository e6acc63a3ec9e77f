"""Heuristic fields of any element, each with a confidence, without a selector configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.patterns import PATTERNS
from pagequarry.functions.text import join_root_relative
from pagequarry.operators.extract import ANY_SITE, Rule, extract_rows
from pagequarry.operators.summary import with_repeats
from pagequarry.sources.parse import node_text

FIELDS = ("title", "price", "image", "link", "rating")

_CURRENCY = PATTERNS["currency_examples"][0].removeprefix("(?i)")
_RATING = PATTERNS["rating_examples"][0]

# Field hints, in order.
HINTS = {
    "title": (
        ".//h1/text()",
        ".//h2//a//span/text()",
        ".//h2//text()",
        ".//h3//text()",
        "largest_text_in_container",
    ),
    "price": (
        './/span[contains(@class,"a-offscreen")]/text()',
        './/span[contains(@class,"price")]/text()',
        "regex:" + _CURRENCY,
    ),
    "image": (".//img[1]/@src", ".//img[1]/@data-src", ".//img[1]/@data-image"),
    "link": (".//a[1]/@href", './/a[contains(@href,"/dp/")]/@href'),
    "rating": (
        './/span[contains(@class,"rating")]/text()',
        './/span[contains(@class,"a-icon-alt")]/text()',
        "regex:" + _RATING.removeprefix("(?i)"),
    ),
}

_RULES = {
    "title1": (Rule(HINTS["title"][0], "xpath"),),
    "title2": (Rule(HINTS["title"][1], "xpath"),),
    "title3": (Rule(HINTS["title"][2], "xpath"),),
    "title4": (Rule(HINTS["title"][3], "xpath"),),
    "price1": (Rule(HINTS["price"][0], "xpath"),),
    "price2": (Rule(HINTS["price"][1], "xpath"),),
    "image1": (Rule(HINTS["image"][0], "xpath"),),
    "image2": (Rule(HINTS["image"][1], "xpath"),),
    "image3": (Rule(HINTS["image"][2], "xpath"),),
    "link1": (Rule(HINTS["link"][0], "xpath"),),
    "rating1": (Rule(HINTS["rating"][1], "xpath"),),
    "rating2": (Rule(HINTS["rating"][0], "xpath"),),
}


def field_hints(spark: SparkSession) -> DataFrame:
    """Hint table (field, rank, hint)."""
    rows = [(f, i, h) for f, hints in HINTS.items() for i, h in enumerate(hints)]
    return spark.createDataFrame(rows, "field string, rank int, hint string")


def heuristic_fields(
    pages: DataFrame,
    containers: tuple[Rule, ...] = (),
    picked: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    parse: dict | None = None,
    notes: dict[str, Column] | None = None,
    parsed: DataFrame | None = None,
) -> DataFrame:
    """(page_id, box_id, and per field value and confidence) for containers given by selectors or by
    an array column of node ids, with `notes` on the containers. Root-relative images and links are resolved against `url`.
    The longest string, which titles fall back to, is a slice of the container's row like any other value."""
    raw = node_text("raw")
    group0 = {
        "price_text": F.nullif(F.regexp_extract(raw, _CURRENCY, 0), F.lit("")),
        "rating_text": F.nullif(F.regexp_extract(raw, _RATING, 0), F.lit("")),
        "longest": F.substr(F.col("stripped"), F.col("long_s") + 1, F.col("long_e") - F.col("long_s")).cast("string"),
        **(notes or {}),
    }
    config = {**_RULES, **({"product_container": containers} if containers else {})}
    rows = extract_rows(
        pages,
        {ANY_SITE: config},
        tuple(_RULES),
        cleaning="raw",
        picked=picked,
        box_values=group0,
        texts=("raw",),
        prepare=prepare,
        parse={"longest": True, **(parse or {})},
        parsed=parsed,
    )

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])

    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    found = rows.select(
        "page_id",
        "box_id",
        first("title1", "title2", "title3", "title4").alias("title"),
        first("price1", "price2").alias("price"),
        "price_text",
        join_root_relative(url, F.nullif(F.coalesce("image1", "image2", "image3"), F.lit(""))).alias("image"),
        join_root_relative(url, F.nullif("link1", F.lit(""))).alias("link"),
        F.coalesce("rating1", "rating2", "rating_text").alias("rating"),
        F.when(F.length("longest") > 7, F.col("longest")).alias("longest"),
        *(notes or {}),
    )

    def sure(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.lit(0.9)).otherwise(F.lit(0.0))

    def scored(value: Column, confidence: Column, name: str) -> Column:
        return F.struct(value.alias("value"), confidence.alias("confidence")).alias(name)

    return found.select(
        "page_id",
        "box_id",
        *(notes or {}),
        scored(
            F.coalesce("title", "longest"),
            F.when(F.col("title").isNotNull(), 0.9).when(F.col("longest").isNotNull(), 0.5).otherwise(0.0),
            "title",
        ),
        scored(
            F.coalesce("price", "price_text"),
            F.when(F.col("price").isNotNull(), 0.9).when(F.col("price_text").isNotNull(), 0.6).otherwise(0.0),
            "price",
        ),
        scored(F.col("image"), sure("image"), "image"),
        scored(F.col("link"), sure("link"), "link"),
        scored(F.nullif("rating", F.lit("")), F.when(F.col("rating") != "", 0.9).otherwise(0.0), "rating"),
    )


def sample_extractions(
    pages: DataFrame, signature_count: int = 3, nodes_each: int = 3, parsed: DataFrame | None = None
) -> DataFrame:
    """Heuristic fields of the first nodes of each page's most repeated signatures: chosen on the page's node array, so the
    extraction goes on with the pages as they were parsed."""

    def choose(parsed: DataFrame) -> DataFrame:
        rows = with_repeats(parsed)
        rows = rows.withColumn("top", F.slice("repeats", F.lit(1), F.lit(signature_count)))
        each = F.transform(
            "top",
            lambda r, k: F.transform(
                F.sequence(F.lit(0), F.least(-r["minus_count"], F.lit(nodes_each)) - 1),
                lambda j: F.struct(
                    F.get(F.col("members"), r["at"] + j)["id"].alias("id"),
                    F.struct((k + 1).alias("rank"), (j + 1).alias("nth"), r["signature"].alias("signature")).alias("note"),
                ),
            ),
        )
        rows = rows.withColumn("chosen", F.flatten(each))
        rows = rows.withColumns({"box_ids": F.transform("chosen", lambda c: c["id"]), "notes": F.map_from_entries("chosen")})
        return rows.drop("members", "repeats", "top", "chosen")

    note = F.element_at("notes", F.col("node_id"))
    rows = heuristic_fields(
        pages, picked="box_ids", prepare=choose, parse={"sizes": True, "whole": True}, notes={"note": note}, parsed=parsed
    )
    return rows.select("page_id", "note.*", *[c for c in rows.columns if c not in ("page_id", "note")])
