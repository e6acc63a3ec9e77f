"""Listing pages rendered from the `part` table, and the rows an extraction must find in them.

Twenty parts make a page. The script string and the commented-out product are traps. `EXPECTED` is
the extraction result computed straight from `part`, without any HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators.extract import ANY_SITE, Rule, css

PER_PAGE = 20

# Fixed value: the card template.
CARD = """concat('<div class="product card" data-id="', p_partkey, '">',
 case when p_partkey % 11 = 0 then '' else concat('<h2><a class="title" href="/dp/', p_partkey, '" title="', p_name, '"> <span>', p_name, '  #', p_partkey, '</span> </a></h2>') end,
 case when p_partkey % 13 = 0 then '' else concat('<span class="price">₹', cast(floor(p_retailprice) as bigint), '</span>') end,
 case when p_partkey % 2 = 0 then concat('<del class="mrp">₹', cast(floor(p_retailprice) as bigint) + 100, '</del>') else '' end,
 case when p_partkey % 5 = 0 then '' when p_partkey % 17 = 0 then '<span class="rating">9.9 out of 5</span>' else concat('<span class="rating">', cast(floor((p_partkey % 50) / 10) as bigint), '.', p_partkey % 10, ' out of 5</span>') end,
 case when p_partkey % 3 = 0 then '' else concat('<span class="reviews">(', p_partkey % 1000, ' ratings)</span>') end,
 case when p_partkey % 4 = 0 then concat('<span>', p_partkey % 70, '% off</span>') else '' end,
 case when p_partkey % 7 = 0 then '' else concat('<div class="offer">Save ', p_partkey % 9, '</div><div class="offer">', p_brand, '</div>') end,
 case when p_partkey % 8 = 0 then '<div class="delivery-info">Free delivery</div>' else '' end,
 case when p_partkey % 9 = 0 then '<span class="stock">In stock</span>' else '' end,
 '<img src="/img/', p_partkey, '.jpg"', case when p_partkey % 6 = 0 then '' else concat(' alt="', p_name, '"') end, '>',
 case when p_partkey % 10 = 0 then '<form action="https://pay.example.com/go" method="post"><input name="email"><input type="password" name="pwd" value="x"><input type="hidden" name="csrf_token" value="t"><select name="qty"></select></form>' else '' end,
 '</div>')"""

# What surrounds the cards.
HEAD = (
    '<html><body><script>var t="</div>";</script><!-- <div class="product"> --><div class="list">'
)
TAIL = "</div></body></html>"

SELECTORS = {
    ANY_SITE: {
        "product_container": css("li.absent", "div.product[data-id]"),
        "name": (Rule("a.title span"), Rule("img[alt]", attribute="alt")),
        "current_price": (Rule('span[class*="price"]', regex=r"₹([\d,]+)"),),
        "original_price": css("del"),
        "rating": (
            Rule('.//span[contains(@class,"rating")]/text()', "xpath", regex=r"(\d+\.?\d*)"),
        ),
        "reviews": css(".reviews"),
        "discount": css('span:contains("% off")'),
        "offers": css("div[class^='offer']"),
        "delivery": css('div[class*="delivery"]'),
        "availability": css("span[class$='stock']"),
    }
}


def render(parts: DataFrame, card: str, head: str, tail: str, per_page: int = PER_PAGE) -> DataFrame:
    """page_id, html from one fragment per part, in key order. A group holds `per_page` parts.

    Pages are a few bytes to shuffle and a lot of work to parse, so the shuffle keeps the session's
    partition count: its bytes say nothing about the work after it.
    """
    partitions = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cards = parts.select(
        F.floor(F.col("p_partkey") / per_page).cast("bigint").alias("page_id"),
        F.struct("p_partkey", F.expr(card).alias("card")).alias("c"),
    )
    return cards.repartition(partitions, "page_id").groupBy("page_id").agg(
        F.concat(
            F.lit(head),
            F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["card"]), ""),
            F.lit(tail),
        ).alias("html")
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    site = F.concat(F.lit("shop"), F.col("page_id") % 4)
    return render(parts, CARD, HEAD, TAIL).select(
        "page_id",
        "html",
        F.concat(F.lit("https://"), site, F.lit(".example.com/list/"), F.col("page_id")).alias("url"),
        site.alias("site"),
    )


EXPECTED = """cards as (
 select p_partkey as k, p_partkey // 20 as page_id, 'shop' || (p_partkey // 20) % 4 as site,
  cast(row_number() over (partition by p_partkey // 20 order by p_partkey) as integer) as "index",
  p_name, p_brand, cast(floor(p_retailprice) as bigint) as price
 from part),
extracted as (
 select k, page_id, site, "index",
  case when k % 11 <> 0 then p_name || ' #' || k when k % 6 <> 0 then p_name end as name,
  case when k % 13 <> 0 then cast(price as varchar) end as current_price,
  case when k % 2 = 0 then '₹' || (price + 100) end as original_price,
  case when k % 5 = 0 then null when k % 17 = 0 then '9.9'
   else ((k % 50) // 10) || '.' || (k % 10) end as rating,
  case when k % 3 <> 0 then '(' || (k % 1000) || ' ratings)' end as reviews,
  case when k % 4 = 0 then (k % 70) || '% off' end as discount,
  case when k % 7 <> 0 then 'Save ' || (k % 9) end as offers,
  case when k % 8 = 0 then 'Free delivery' end as delivery,
  case when k % 9 = 0 then 'In stock' end as availability
 from cards),
products as (select * from extracted where name is not null or current_price is not null)
"""
