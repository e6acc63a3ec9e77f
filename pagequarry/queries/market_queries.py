"""Site-specific, card and list-schema extraction over rendered marketplace pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import cards, legacy
from pagequarry.operators.extract import ANY_SITE, css, extract_rows
from pagequarry.operators.sites import built_in_sites, list_schema
from pagequarry.queries.market import EXPECTED, market_pages, market_partitions
from pagequarry.queries.registry import query
from pagequarry.schema import CARD_COLUMNS

COLUMNS = (
    "name, current_price, original_price, rating, reviews, discount, offers, delivery, availability"
)


def _with(sql: str, *more: str) -> str:
    return "with " + ", ".join([EXPECTED, *more]) + " " + sql


def _flat(rows):
    return rows.withColumn("offers", F.array_join("offers", "; "))


@query("site_products", _with(f'select site, page_id, "index", {COLUMNS} from kept'))
def site_products(spark, sf_dir):
    rows = legacy.extract_site_products(market_pages(spark, sf_dir), built_in_sites(), market_partitions(spark, sf_dir))
    return _flat(rows).select("site", "page_id", "index", *COLUMNS.split(", "))


def _one_site(site: str, columns: str):
    def run(spark, sf_dir):
        rows = legacy.extract_site_rows(market_pages(spark, sf_dir), {site: built_in_sites()[site]}, market_partitions(spark, sf_dir))
        return _flat(rows).select("page_id", "index", *columns.split(", "))

    return run


for _site, _columns in (
    ("sathya", "name, original_price"),
    ("flipkart", "name, offers"),
    ("amazon", "offers, delivery, availability"),
):
    query(
        f"{_site}_chains",
        _with(f"""select page_id, "index", {_columns} from site_rows where site = '{_site}'"""),
    )(_one_site(_site, _columns))


@query(
    "fallback_containers",
    _with(
        """select page_id, count(*) as containers from market where site = 'flipkart' group by page_id"""
    ),
)
def fallback_containers(spark, sf_dir):
    config = {"flipkart": {"product_container": built_in_sites()["flipkart"]["product_container"]}}
    boxes = extract_rows(market_pages(spark, sf_dir), legacy.with_fallback_boxes(config), ())
    return boxes.groupBy("page_id").agg(F.count(F.lit(1)).alias("containers"))


@query(
    "valid_names_per_site",
    _with("select site, count(*) as products, count(current_price) as priced from kept group by site"),
)
def valid_names_per_site(spark, sf_dir):
    rows = legacy.extract_site_products(market_pages(spark, sf_dir), built_in_sites(), market_partitions(spark, sf_dir))
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("products"), F.count("current_price").alias("priced")
    )


# Cards come first, then price blocks (all empty as cards), then one help box of two equal ones. On
# other sites only the help box's link points to a container.
CARDS = """cards as (select page_id, 'product_' || "index" as product_id,
 case when k % 11 = 0 then null when k % 3 = 0 then p_name || ' case' when k % 3 = 1 then p_name || ' title'
  when k % 2 = 0 then p_name || ' text' else p_name || ' plink' end as title,
 case when k % 13 <> 0 then '₹' || price end as current_price,
 case when k % 13 <> 0 and k % 2 = 0 then '₹' || (price + 100) end as original_price,
 case when k % 13 <> 0 and k % 4 = 0 then (k % 70) || '% off' end as discount,
 case when k % 5 <> 0 then stars end as rating,
 case when k % 5 <> 0 then '(' || (k % 1000) || ' ratings)' end as rating_count,
 case when k % 11 <> 0 and k % 3 = 0 then '/i/' || k || '.jpg' end as image_url,
 case when k % 11 <> 0 and k % 3 <> 0 then '/x/p/' || k end as product_url,
 k % 6 = 0 as wishlist_available from market where site = 'flipkart' and (k % 11 <> 0 or k % 13 <> 0)
union all select page_id, 'product_' || (case when site = 'flipkart' then count(*) + count(*) filter (where k % 13 <> 0) else 0 end + 1),
 'Help', null, null, null, null, null, null, '/help/p/1', false from market group by page_id, site)"""


@query("cards", _with("select * from cards", CARDS))
def card_rows(spark, sf_dir):
    return cards.cards(market_pages(spark, sf_dir)).select("page_id", *CARD_COLUMNS)


@query(
    "card_counts",
    _with(
        """select count(*) as total_products, count(title) as with_titles, count(current_price) as with_prices,
 count(image_url) as with_images, count(rating) as with_ratings from cards""",
        CARDS,
    ),
)
def card_counts(spark, sf_dir):
    return cards.card_counts(cards.cards(market_pages(spark, sf_dir)))


@query(
    "looks_like_card",
    _with(
        """select page_id, case when site = 'flipkart' then 1 + count(*) + count(*) filter (where k % 13 <> 0) + 2
  else 2 end as containers from market group by page_id, site"""
    ),
)
def looks_like_card(spark, sf_dir):
    boxes = cards.looks_like_card(market_pages(spark, sf_dir).select("page_id", "html"))
    return boxes.groupBy("page_id").agg(F.count(F.lit(1)).alias("containers"))


@query(
    "list_schema",
    _with(
        """select page_id, "index", case when k % 11 <> 0 then p_name end as name,
 case when k % 13 <> 0 then '₹' || price when k % 2 = 0 then '₹' || (price + 100) end as current_price,
 case when k % 2 = 0 then '₹' || (price + 100) end as original_price,
 case when k % 5 <> 0 then stars end as rating,
 case when k % 3 <> 0 then '(' || (k % 1000) || ')' end as reviews,
 case when k % 7 <> 0 then 'Save ' || (k % 9) end as discount,
 case when k % 9 = 0 then 'In stock' end as availability
 from market where site = 'meesho'
  and not (k % 11 = 0 and k % 13 = 0 and k % 2 = 1 and k % 5 = 0 and k % 3 = 0 and k % 7 = 0 and k % 9 <> 0)"""
    ),
)
def list_schema_rows(spark, sf_dir):
    config = {ANY_SITE: {**list_schema(), "product_container": css("div.product")}}
    fields = tuple(list_schema())
    rows = extract_rows(
        market_pages(spark, sf_dir).filter("site = 'meesho'"), config, fields, lists=True, cleaning="strip"
    )
    present = F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields]).isNotNull()
    return rows.filter(present).select(
        "page_id", "index", "name", "current_price", "original_price", "rating", "reviews", "discount", "availability"
    )
