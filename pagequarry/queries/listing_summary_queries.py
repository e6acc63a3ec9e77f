"""Image, form, heuristic and probe queries over listing pages rendered from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions.patterns import PATTERNS
from pagequarry.operators import search, summary
from pagequarry.operators.extract import css
from pagequarry.operators.heuristics import heuristic_fields, sample_extractions
from pagequarry.queries.listing import CARD, listing_pages
from pagequarry.queries.registry import query
from pagequarry.sources.parse import node_rows, parse_pages

CARDS = """cards as (select p_partkey as k, p_partkey // 20 as page_id, p_name, p_brand,
 cast(floor(p_retailprice) as bigint) as price from part)"""


def _with(sql: str, *more: str) -> str:
    return "with " + ", ".join([CARDS, *more]) + " " + sql


def nodes(spark, sf_dir):
    return node_rows(parse_pages(listing_pages(spark, sf_dir), texts=()))


@query(
    "image_stats",
    _with("""select page_id, count(*) as images, count(*) filter (where k % 6 = 0) as missing_alt,
 0 as external_images from cards group by page_id"""),
)
def image_stats(spark, sf_dir):
    return summary.image_stats(nodes(spark, sf_dir))


@query(
    "top_image_sources",
    _with("""select page_id, cast(row_number() over (partition by page_id order by k) as integer) as rank,
 '/img/' || k || '.jpg' as src, 1 as count from cards"""),
)
def top_image_sources(spark, sf_dir):
    return summary.top_values(nodes(spark, sf_dir), "src")


@query(
    "top_image_sources_corpus",
    _with("""select cast(row_number() over (order by k) as integer) as rank, '/img/' || k || '.jpg' as src, 1 as count
 from cards qualify rank <= 30"""),
)
def top_image_sources_corpus(spark, sf_dir):
    return summary.corpus_top_values(nodes(spark, sf_dir), "src")


@query(
    "form_controls",
    _with("""select page_id, count(*) filter (where k % 10 = 0) as forms, 3 * count(*) filter (where k % 10 = 0) as inputs,
 count(*) filter (where k % 10 = 0) as selects, 0 as textareas from cards group by page_id"""),
)
def form_controls(spark, sf_dir):
    return summary.form_controls(nodes(spark, sf_dir))


@query(
    "top_input_types",
    _with("""select page_id, cast(o as integer) as rank, t as input_type, count(*) as count from cards
 cross join (values (1, 'text'), (2, 'password'), (3, 'hidden')) as v(o, t) where k % 10 = 0 group by all"""),
)
def top_input_types(spark, sf_dir):
    return summary.top_values(nodes(spark, sf_dir), "input_type")


@query(
    "forms",
    _with("""select page_id, 'https://pay.example.com/go' as action, 'POST' as method, true as external_action,
 4 as input_count, true as likely_login_form,
 'email/input/false/-/false|pwd/password/true/REDACTED/true|csrf_token/hidden/true/REDACTED/true|qty/select/false/-/false' as inputs
 from cards where k % 10 = 0"""),
)
def forms(spark, sf_dir):
    rows = summary.forms(nodes(spark, sf_dir))
    line = lambda i: F.concat_ws(
        "/",
        i["name"],
        i["type"],
        i["has_value"].cast("string"),
        F.coalesce(i["redacted_value"], F.lit("-")),
        i["suspicious"].cast("string"),
    )
    return rows.drop("form_id").withColumn("inputs", F.array_join(F.transform("inputs", line), "|"))


@query(
    "form_flags",
    _with("""select page_id, true as has_forms_posting_external, true as has_login_form from cards
 where k % 10 = 0 group by page_id"""),
)
def form_flags(spark, sf_dir):
    return summary.form_flags(nodes(spark, sf_dir))


@query(
    "listing_depth",
    _with("""select page_id, max(case when k % 11 <> 0 then 6 else 4 end) as max_dom_depth from cards group by page_id"""),
)
def listing_depth(spark, sf_dir):
    return summary.max_depth(nodes(spark, sf_dir))


# All strings of a card in document order, and the same as one text.
STRINGS = """strings as (select k, page_id, o, trim(s) as s from (select k, page_id, unnest(l) as s, generate_subscripts(l, 1) as o from (
 select k, page_id, [
  case when k % 11 <> 0 then p_name || '  #' || k else '' end,
  case when k % 13 <> 0 then '₹' || price else '' end,
  case when k % 2 = 0 then '₹' || (price + 100) else '' end,
  case when k % 5 = 0 then '' when k % 17 = 0 then '9.9 out of 5' else ((k % 50) // 10) || '.' || (k % 10) || ' out of 5' end,
  case when k % 3 <> 0 then '(' || (k % 1000) || ' ratings)' else '' end,
  case when k % 4 = 0 then (k % 70) || '% off' else '' end,
  case when k % 7 <> 0 then 'Save ' || (k % 9) else '' end,
  case when k % 7 <> 0 then p_brand else '' end,
  case when k % 8 = 0 then 'Free delivery' else '' end,
  case when k % 9 = 0 then 'In stock' else '' end] as l from cards)) where s <> '')"""
TEXTS = """texts as (select k, string_agg(case when o = 1 then ' ' || s || ' ' else s end, '' order by o) as txt,
 arg_max(s, length(s) * 100 - o) as longest from strings group by k)"""
_CURRENCY = PATTERNS["currency_examples"][0].removeprefix("(?i)").replace("'", "''")
_RATING = PATTERNS["rating_examples"][0].replace("'", "''")


@query(
    "heuristic_fields",
    _with(
        f"""select page_id, pos, title, case when k % 11 <> 0 then 0.9::double when title is not null then 0.5::double else 0::double end as title_confidence,
 price, case when k % 13 <> 0 then 0.9::double when price is not null then 0.6::double else 0::double end as price_confidence,
 'https://shop' || (page_id % 4) || '.example.com/img/' || k || '.jpg' as image, 0.9::double as image_confidence,
 case when k % 11 <> 0 then 'https://shop' || (page_id % 4) || '.example.com/dp/' || k end as link,
 case when k % 11 <> 0 then 0.9::double else 0::double end as link_confidence,
 rating, case when rating is not null then 0.9::double else 0::double end as rating_confidence from (
 select k, page_id, row_number() over (partition by page_id order by k) as pos,
  case when k % 11 <> 0 then p_name || '  #' || k when length(longest) > 7 then longest end as title,
  case when k % 13 <> 0 then '₹' || c.price else nullif(regexp_extract(coalesce(txt, ''), '{_CURRENCY}'), '') end as price,
  case when k % 5 = 0 then nullif(regexp_extract(coalesce(txt, ''), '{_RATING}'), '') when k % 17 = 0 then '9.9 out of 5'
   else ((k % 50) // 10) || '.' || (k % 10) || ' out of 5' end as rating
 from cards c left join texts using (k))""",
        STRINGS,
        TEXTS,
    ),
)
def heuristics(spark, sf_dir):
    from pyspark.sql import Window

    rows = heuristic_fields(listing_pages(spark, sf_dir), css("div.product"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("box_id"))
    fields = ("title", "price", "image", "link", "rating")
    return rows.select(
        "page_id",
        place.alias("pos"),
        *[F.col(f"{f}.value").alias(f) for f in fields],
        *[F.col(f"{f}.confidence").alias(f"{f}_confidence") for f in fields],
    )


@query("sample_extractions")
def samples(spark, sf_dir):
    rows = sample_extractions(listing_pages(spark, sf_dir))
    return rows.select(
        "page_id", "rank", "nth", F.to_json("signature").alias("signature"), "title.value", "price.confidence"
    )


@query(
    "selector_probe",
    _with("""select page_id, 'div[data-id]' as selector, count(*) as elements, 'product card' as sample_class,
 cast(min(k) as varchar) as sample_data_id from cards group by page_id"""),
)
def selector_probe(spark, sf_dir):
    return search.css_counts(listing_pages(spark, sf_dir), search.PROBED)


@query(
    "container_probe",
    _with("""select page_id, case when k % 13 <> 0 then 1 else 0 end as price_elements,
 case when k % 13 <> 0 then 'price:₹' || price else '' end as prices,
 case when k % 11 <> 0 then 'a:' || p_name else '' end as names
 from cards where k % 20 = 0"""),
)
def container_probe(spark, sf_dir):
    rows = search.container_probe(listing_pages(spark, sf_dir))
    priced = F.transform("prices", lambda p: F.concat(p["class"], F.lit(":"), p["text"]))
    named = F.transform("names", lambda n: F.concat(n["tag"], F.lit(":"), n["title"]))
    return rows.select(
        "page_id",
        "price_elements",
        F.array_join(priced, "|").alias("prices"),
        F.array_join(named, "|").alias("names"),
    )


# Cards are cut out of the page exactly as they were rendered.
@query("card_source", f"select p_partkey // 20 as page_id, {CARD.replace('floor(p_retailprice)', 'floor(p_retailprice)')} as content from part")
def card_source(spark, sf_dir):
    from pagequarry.sources.parse import outer_html

    rows = node_rows(parse_pages(listing_pages(spark, sf_dir), texts=(), source=True))
    return rows.filter(F.col("attrs")["data-id"].isNotNull()).select(
        "page_id", outer_html().alias("content")
    )
