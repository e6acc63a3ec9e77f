"""Pages of four marketplaces rendered from `part`, one site per page, and the rows they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.queries.listing import PER_PAGE, render

SITES = ("amazon", "flipkart", "meesho", "sathya")

_PRICE = "cast(floor(p_retailprice) as bigint)"
_RATING = "concat(cast(floor((p_partkey % 50) / 10) as bigint), '.', p_partkey % 10)"


def _if(test: str, fragment: str, other: str = "''") -> str:
    return f"case when {test} then {fragment} else {other} end"


_K, _NAME, _BRAND = "p_partkey", "p_name", "p_brand"

# Delivery and availability are the same on every site: a classed element, else a plain string.
_TAIL = ", ".join(
    (
        _if(f"{_K} % 8 = 0", "'<div class=\"delivery-info\">Free delivery</div>'"),
        _if(f"{_K} % 8 = 1", "'<p> Fast Shipping today </p>'"),
        _if(f"{_K} % 9 = 0", "'<span class=\"stock\">In stock</span>'"),
        _if(f"{_K} % 9 = 1", "'<p>12 bought</p>'"),
    )
)

AMAZON = f"""concat('<div data-component-type="s-search-result">',
 {_if(f"{_K} % 11 <> 0", f"concat('<h2 class=\"a-size-medium\"><span>', {_NAME}, ' ', {_BRAND}, '</span></h2>')")},
 {_if(f"{_K} % 13 <> 0", f"concat('<span class=\"a-price-whole\">', {_PRICE}, '</span>')")},
 {_if(f"{_K} % 2 = 0", f"concat('<span class=\"a-price a-text-price\">', {_PRICE} + 100, '</span>')")},
 {_if(f"{_K} % 5 <> 0", f"concat('<span class=\"a-icon-alt\">', {_RATING}, ' out of 5</span>')")},
 {_if(f"{_K} % 3 <> 0", f"concat('<span class=\"a-size-mini\">(', {_K} % 1000, ')</span>')")},
 {_if(f"{_K} % 4 = 0", f"concat('<span>', {_K} % 70, '% off</span>')")},
 {_if(f"{_K} % 7 <> 0", f"concat('<span class=\"s-coupon-unclipped\">Save ', {_K} % 9, '</span><span class=\"s-coupon-unclipped\">', {_BRAND}, '</span>')")},
 {_if(f"{_K} % 6 = 0", f"concat('<span>Get coupon ', {_K}, '</span>')")},
 {_TAIL}, '</div>')"""

# Every other flipkart page carries a fallback container class.
FLIPKART = f"""concat('<div class="', {_if(f"floor({_K} / {PER_PAGE}) % 8 = 1", "'_4WELSP'", "'slAVV4'")}, ' tile" data-k="', {_K}, '">',
 case when {_K} % 11 = 0 then ''
  when {_K} % 3 = 0 then concat('<img class="DByuf4" src="/i/', {_K}, '.jpg" alt="', {_NAME}, ' case">')
  when {_K} % 3 = 1 then concat('<a class="wjcEIp" href="/x/p/', {_K}, '" title="', {_NAME}, ' title">t</a>')
  when {_K} % 2 = 0 then concat('<a class="wjcEIp" href="/x/p/', {_K}, '">', {_NAME}, ' text</a>')
  else concat('<a href="/x/p/', {_K}, '" title="', {_NAME}, ' plink">z</a>') end,
 {_if(f"{_K} % 13 <> 0", f'''concat('<div class="hl05eU"><div class="Nx9bqj">₹', {_PRICE}, '</div>',
  {_if(f"{_K} % 2 = 0", f"concat('<div class=yRaY8j>₹', {_PRICE} + 100, '</div>')")},
  {_if(f"{_K} % 4 = 0", f"concat('<div class=UkUFwK><span>', {_K} % 70, '% off</span></div>')")}, '</div>')''')},
 {_if(f"{_K} % 5 <> 0", f'''concat('<div class="_5OesEi afFzxY"><span class="Y1HWO0"><div class="XQDdHH">', {_RATING},
  '</div></span><span class="Wphh3N">(', {_K} % 1000, ' ratings)</span></div>')''')},
 {_if(f"{_K} % 6 = 0", "'<div class=\"+7E521\">♡</div>'")},
 {_if(f"{_K} % 7 <> 0", f"concat('<div class=offer>Save ', {_K} % 9, '</div>')")},
 {_TAIL}, '</div>')"""

MEESHO = f"""concat('<div class="product">',
 {_if(f"{_K} % 11 <> 0", f"concat('<h3>', {_NAME}, '</h3>')")},
 {_if(f"{_K} % 13 <> 0", f"concat('<span class=\"price\">₹', {_PRICE}, '</span>')")},
 {_if(f"{_K} % 2 = 0", f"concat('<span class=\"strike\">₹', {_PRICE} + 100, '</span>')")},
 {_if(f"{_K} % 5 <> 0", f"concat('<span class=\"rating\">', {_RATING}, '</span>')")},
 {_if(f"{_K} % 3 <> 0", f"concat('<span class=\"review\">(', {_K} % 1000, ')</span>')")},
 {_if(f"{_K} % 4 = 0", f"concat('<span>', {_K} % 70, '% off</span>')")},
 {_if(f"{_K} % 7 <> 0", f"concat('<div class=\"coupon\">', {_BRAND}, '</div><span class=\"offer\">Save ', {_K} % 9, '</span>')")},
 {_TAIL}, '</div>')"""

SATHYA = f"""concat('<div class="product-box">',
 case {_K} % 5 when 0 then concat('<img src="/i/', {_K}, '.jpg" alt=" ', {_NAME}, ' ">')
  when 1 then concat('<a href="/category/big-', replace({_NAME}, ' ', '-'), '-', {_K}, '">x</a>')
  when 2 then concat('<div class="product-detail"><h4>', {_NAME}, ' detail</h4></div>')
  when 3 then concat('<p>', {_NAME}, ' line', chr(10), 'rest</p>') else '<i>₹</i>' end,
 {_if(f"{_K} % 13 <> 0", f"concat('<span>₹', {_PRICE}, '</span>')")},
 case when {_K} % 2 = 0 then concat('<p>MRP: ₹', {_PRICE} + 100, '</p>')
  when {_K} % 3 = 0 then concat('<p>M.R.P: ', {_PRICE} + 200, '/-</p>') else '' end,
 {_if(f"{_K} % 5 <> 0", f"concat('<div class=\"rating\">', {_RATING}, '</div>')")},
 {_if(f"{_K} % 3 <> 0", f"concat('<span class=\"review\">(', {_K} % 1000, ')</span>')")},
 {_if(f"{_K} % 4 = 0", f"concat('<span>', {_K} % 70, '% off</span>')")},
 {_if(f"{_K} % 7 <> 0", f"concat('<span class=\"offer\">Save ', {_K} % 9, '</span>')")},
 {_TAIL}, '</div>')"""

CARD = f"""case floor({_K} / {PER_PAGE}) % 4 when 0 then {AMAZON} when 1 then {FLIPKART}
 when 2 then {MEESHO} else {SATHYA} end"""

HEAD = '<html><body><div class="grid">'
# Two equal help boxes: a link's closest div counts once per content.
HELP = '<div><a href="/help/p/1">Help</a></div>'
TAIL = f"</div><footer>{HELP}{HELP}</footer></body></html>"


# Parts whose nodes one task of the windows over pages takes.
PARTS_PER_TASK = 6000


def market_partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for the windows over the pages, so that one does not grow with the parts; none while the session's shuffles have as many."""
    wanted = -(-spark.read.parquet(f"{sf_dir}/part.parquet").count() // PARTS_PER_TASK)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def market_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = F.array(*[F.lit(s) for s in SITES])
    return render(parts, CARD, HEAD, TAIL).select(
        "page_id", "html", F.element_at(names, (F.col("page_id") % 4 + 1).cast("int")).alias("site")
    )


# What the four sites must give, computed from `part`; `kept` passes the name checks.
EXPECTED = """market as (select p_partkey as k, p_partkey // 20 as page_id, p_name, p_brand,
  ['amazon', 'flipkart', 'meesho', 'sathya'][(p_partkey // 20) % 4 + 1] as site,
  cast(row_number() over (partition by p_partkey // 20 order by p_partkey) as integer) as "index",
  cast(floor(p_retailprice) as bigint) as price,
  ((p_partkey % 50) // 10) || '.' || (p_partkey % 10) as stars from part),
site_rows as (select k, page_id, site, "index",
 case site when 'amazon' then case when k % 11 <> 0 then p_name || ' ' || p_brand end
  when 'flipkart' then case when k % 11 = 0 then null when k % 3 = 0 then p_name || ' case'
   when k % 3 = 1 then p_name || ' title' when k % 2 = 0 then p_name || ' text' else p_name || ' plink' end
  when 'meesho' then case when k % 11 <> 0 then p_name end
  else case k % 5 when 0 then p_name
   when 1 then 'Big ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || k
   when 2 then p_name || ' detail' when 3 then p_name || ' line' end end as name,
 case when site = 'sathya' then case when k % 13 <> 0 then '₹' || price when k % 2 = 0 then 'MRP: ₹' || (price + 100) end
  when k % 13 <> 0 then case when site = 'amazon' then '' else '₹' end || price end as current_price,
 case site when 'amazon' then case when k % 2 = 0 then cast(price + 100 as varchar) end
  when 'flipkart' then case when k % 13 <> 0 and k % 2 = 0 then '₹' || (price + 100) end
  when 'meesho' then case when k % 2 = 0 then '₹' || (price + 100) end
  else case when k % 2 = 0 then '₹' || (price + 100) when k % 3 = 0 then '₹' || (price + 200) end end as original_price,
 case when k % 5 <> 0 then stars || case when site = 'amazon' then ' out of 5' else '' end end as rating,
 case when site = 'flipkart' then case when k % 5 <> 0 then '(' || (k % 1000) || ' ratings)' end
  when k % 3 <> 0 then '(' || (k % 1000) || ')' end as reviews,
 case when k % 4 = 0 and (site <> 'flipkart' or k % 13 <> 0) then (k % 70) || '% off'
  when site = 'sathya' and k % 7 <> 0 then 'Save ' || (k % 9) end as discount,
 array_to_string(case site
  when 'amazon' then list_concat(case when k % 7 <> 0 then ['Save ' || (k % 9), p_brand] else [] end,
   case when k % 6 = 0 then ['Get coupon ' || k] else [] end)
  when 'flipkart' then list_concat(case when k % 6 = 0 then ['♡'] else [] end, case when k % 7 <> 0 then ['Save ' || (k % 9)] else [] end)
  when 'meesho' then case when k % 7 <> 0 then ['Save ' || (k % 9), p_brand] else [] end
  else case when k % 7 <> 0 then ['Save ' || (k % 9)] else [] end end, '; ') as offers,
 case k % 8 when 0 then 'Free delivery' when 1 then 'Fast Shipping today' end as delivery,
 case k % 9 when 0 then 'In stock' when 1 then '12 bought' end as availability from market),
kept as (select * from site_rows where name is not null
 and length(name) >= case site when 'amazon' then 10 when 'flipkart' then 5 when 'sathya' then 2 else 3 end)
"""
