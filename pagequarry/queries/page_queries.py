"""Summaries, search and extraction over the raw `pages` table, and text reports on `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import text as tx
from pagequarry.functions.patterns import EXAMPLE_CAP, PATTERNS, SHOP_WORDS
from pagequarry.operators import quality, search, summary
from pagequarry.operators.extract import ANY_SITE, Rule, css, extract_products
from pagequarry.queries.registry import joined, query
from pagequarry.queries.tree_sql import PATHS, SIGNATURE_JSON, SIGNATURES, fragment, tree
from pagequarry.sources import table_functions
from pagequarry.sources.pages import read_pages, read_table, split_pages
from pagequarry.sources.parse import node_rows, parse_pages


def pages(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def nodes(spark, sf_dir):
    return node_rows(parse_pages(pages(spark, sf_dir), texts=()))


def documents(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "text", "lang")


# Opening tags by regex; attributes are name="value" in these pages.
TAGS = """tags as (select page_id, i, lower(regexp_extract(body, '<([a-zA-Z0-9]+)', 1)) as tag, body from (
 select page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*[^>]*>')) as body,
  generate_subscripts(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*[^>]*>'), 1) as i from pages))"""
LINKS = """links as (select page_id, i, trim(regexp_extract(body, 'href="([^"]*)"', 1)) as href
 from tags where tag = 'a')"""
ATTRS = """attrs as (select page_id, i, j, tag, regexp_extract(a, '^([a-z-]+)=', 1) as attribute,
  regexp_extract(a, '"(.*)"', 1) as value from (
  select page_id, i, tag, unnest(regexp_extract_all(body, '[a-z-]+="[^"]*"')) as a,
   generate_subscripts(regexp_extract_all(body, '[a-z-]+="[^"]*"'), 1) as j from tags))"""


def _with(sql: str, *ctes: str) -> str:
    return "with " + ", ".join(ctes) + " " + sql


def _top(value: str, source: str, n: int, by: str = "page_id", first: str = "i") -> str:
    part = f"partition by {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""select {lead}rank, {value}, count from (select *,
 cast(row_number() over ({part} order by count desc, first) as integer) as rank from (
  select {lead}{value}, count(*) as count, min({first}) as first from {source} group by all)) where rank <= {n}"""


@query("page_scan", "select page_id, url, length(html) as chars, octet_length(encode(html)) as bytes from pages")
def page_scan(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", "url", F.length("html").alias("chars"), F.octet_length("html").alias("bytes")
    )


@query(
    "empty_page_split",
    """select case when coalesce(trim(h), '') = '' then 'no html content' else 'ok' end as outcome, count(*) as pages
 from (select case when page_id % 5 = 0 then '' when page_id % 7 = 0 then null else html end as h from pages) group by 1""",
)
def empty_page_split(spark, sf_dir):
    blanked = pages(spark, sf_dir).withColumn(
        "html", F.expr("case when page_id % 5 = 0 then '' when page_id % 7 = 0 then null else html end")
    )
    ok, rejected = split_pages(blanked)
    outcomes = ok.select(F.lit("ok").alias("outcome")).unionByName(
        rejected.select(F.col("reason").alias("outcome"))
    )
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


@query("page_meta", """select page_id, octet_length(encode(html)) as size_bytes,
 trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title,
 regexp_extract(html, '(?i)<meta[^>]*charset=["'']?([^"''>\\s]+)', 1) as charset from pages""")
def page_meta(spark, sf_dir):
    return summary.page_meta(pages(spark, sf_dir))


@query(
    "element_counts",
    _with("select tag, count(*) as count, count(distinct page_id) as pages from tags group by tag", TAGS),
)
def element_counts(spark, sf_dir):
    per_page = nodes(spark, sf_dir).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("pages"))


@query(
    "tag_totals",
    _with("select page_id, count(*) as total_nodes, count(distinct tag) as unique_tags from tags group by page_id", TAGS),
)
def tag_totals(spark, sf_dir):
    rows = nodes(spark, sf_dir)
    totals = summary.frequencies(rows, ("tag",)).groupBy("page_id")
    return totals.agg(F.sum("count").alias("total_nodes"), F.count(F.lit(1)).alias("unique_tags"))


@query("top_tags", _with(_top("tag", "tags", 10), TAGS))
def top_tags(spark, sf_dir):
    return summary.top_values(nodes(spark, sf_dir), "tag")


@query("top_tags_corpus", _with(_top("tag", "tags", 20, "", "page_id * 100000 + i"), TAGS))
def top_tags_corpus(spark, sf_dir):
    return summary.top_values(nodes(spark, sf_dir), "tag", by=(), n=20)


@query(
    "headings",
    _with(
        "select page_id, "
        + ", ".join(f"count(*) filter (where tag = 'h{i}') as h{i}" for i in range(1, 7))
        + " from tags group by page_id",
        TAGS,
    ),
)
def headings(spark, sf_dir):
    return summary.headings(nodes(spark, sf_dir))


@query("max_depth", tree("select page_id, cast(max(depth) as integer) as max_dom_depth from elements group by page_id"))
def max_depth(spark, sf_dir):
    return summary.max_depth(nodes(spark, sf_dir))


ABSOLUTE = "regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://')"


@query(
    "link_stats",
    _with(
        f"""select page_id, count(*) as links, count(*) filter (where href = '') as empty_hrefs,
 count(*) filter (where {ABSOLUTE}) as external_links,
 count(*) filter (where href <> '' and not {ABSOLUTE}) as internal_links,
 count(*) filter (where lower(href) like 'mailto:%') as mailto_links,
 count(*) filter (where lower(href) like 'tel:%') as tel_links from links group by page_id""",
        TAGS,
        LINKS,
    ),
)
def link_stats(spark, sf_dir):
    return summary.link_stats(nodes(spark, sf_dir))


@query("top_hrefs", _with(_top("href", "links", 30), TAGS, LINKS))
def top_hrefs(spark, sf_dir):
    return summary.top_values(nodes(spark, sf_dir), "href")


@query("top_hrefs_corpus", _with(_top("href", "links", 30, "", "page_id * 100000 + i"), TAGS, LINKS))
def top_hrefs_corpus(spark, sf_dir):
    return summary.corpus_top_values(nodes(spark, sf_dir), "href")


@query(
    "script_stats",
    _with(
        """select page_id, count(*) filter (where tag = 'script') as scripts,
 count(*) filter (where tag = 'script' and body not like '% src=%') as inline_scripts,
 count(*) filter (where tag = 'script' and body like '% src=%') as external_scripts,
 count(*) filter (where tag = 'link' and (body like '%rel="stylesheet"%' or body like '%.css%')) as stylesheets,
 count(*) filter (where tag = 'style') as style_blocks from tags group by page_id""",
        TAGS,
    ),
)
def script_stats(spark, sf_dir):
    return summary.script_stats(nodes(spark, sf_dir))


CLASSES = """tokens as (select page_id, i, unnest(string_split(value, ' ')) as class
 from attrs where attribute = 'class')"""


@query("top_classes", _with(_top("class", "tokens", 50), TAGS, ATTRS, CLASSES))
def top_classes(spark, sf_dir):
    return summary.top_values(nodes(spark, sf_dir), "class")


@query("top_classes_corpus", _with(_top("class", "tokens", 50, "", "page_id * 100000 + i"), TAGS, ATTRS, CLASSES))
def top_classes_corpus(spark, sf_dir):
    return summary.corpus_top_values(nodes(spark, sf_dir), "class")


@query(
    "unique_classes",
    _with(
        "select page_id, count(distinct class) as unique_classes, count(distinct id) as unique_ids from ("
        "select page_id, class, null as id from tokens union all "
        "select page_id, null, value from attrs where attribute = 'id') group by page_id",
        TAGS,
        ATTRS,
        CLASSES,
    ),
)
def unique_classes(spark, sf_dir):
    return summary.unique_counts(nodes(spark, sf_dir), ("class", "id"))


@query(
    "attribute_counts",
    _with(
        """select page_id, tag, rank, attribute, count from (select *,
 cast(row_number() over (partition by page_id, tag order by count desc, first) as integer) as rank from (
  select page_id, tag, attribute, count(*) as count, min(i * 1000 + j) as first from attrs group by all)) where rank <= 40""",
        TAGS,
        ATTRS,
    ),
)
def attribute_counts(spark, sf_dir):
    return summary.attribute_counts(nodes(spark, sf_dir))


@query(
    "attribute_values",
    _with(
        """select tag, attribute, rank, value, count from (select *,
 cast(row_number() over (partition by tag, attribute order by count desc, first) as integer) as rank from (
  select tag, attribute, value, count(*) as count, min(page_id * 100000 + i) as first from attrs
  where value <> '' group by all)) where rank <= 10""",
        TAGS,
        ATTRS,
    ),
)
def attribute_values(spark, sf_dir):
    return summary.attribute_values(nodes(spark, sf_dir), by=())


@query(
    "confidence",
    _with(
        """select page_id, round(score, 3) as js_score, round(empty, 3) as empty_anchor_ratio, many as lots_of_classes,
 (score > 0.05 or empty > 0.2 or many) as is_likely_js_heavy from (
 select t.page_id, least(1.0::double, s::double / greatest(1, n) * 10 + i::double / (s + 1)) as score,
  e::double / greatest(1, l) as empty, coalesce(c, 0) > 100 as many from (
  select page_id, count(*) as n, count(*) filter (where tag = 'script') as s,
   count(*) filter (where tag = 'script' and body not like '% src=%') as i,
   count(*) filter (where tag = 'a') as l from tags group by page_id) t
  join (select page_id, count(*) filter (where href = '') as e from links group by page_id) using (page_id)
  left join (select page_id, count(distinct class) as c from tokens group by page_id) using (page_id))""",
        TAGS,
        LINKS,
        ATTRS,
        CLASSES,
    ),
)
def confidence(spark, sf_dir):
    return summary.confidence(nodes(spark, sf_dir))


@query(
    "text_stats",
    tree(
        """select page_id, count(*) as text_nodes, cast(sum(length(content)) + count(*) - 1 as bigint) as total_text_chars,
 cast(sum(len(regexp_extract_all(content, '[A-Za-z0-9'']{2,}'))) as bigint) as word_count,
 arg_max(length(content), length(content) * 100000 - nid) as longest_text_node_length,
 arg_max(case when length(content) > 400 then content[:400] || '...' else content end, length(content) * 100000 - nid) as longest_text_node_preview,
 sum(len(regexp_extract_all(content, '[A-Za-z0-9'']{2,}')))::double / count(*) as avg_words_per_text_node
 from texts group by page_id"""
    ),
)
def text_stats(spark, sf_dir):
    return summary.text_stats(pages(spark, sf_dir))


@query(
    "page_top_words",
    tree(
        """select page_id, cast(rank as integer) as rank, word, count from (select *,
  row_number() over (partition by page_id order by count desc, first) as rank from (
   select page_id, lower(w) as word, count(*) as count, min(nid * 100000 + i) as first from (
    select page_id, nid, unnest(l) as w, generate_subscripts(l, 1) as i from (
     select page_id, nid, regexp_extract_all(content, '[A-Za-z0-9'']{2,}') as l from texts)) group by all)) where rank <= 50"""
    ),
)
def page_top_words(spark, sf_dir):
    return summary.page_top_words(pages(spark, sf_dir))


@query(
    "repeated_signatures",
    tree(
        f"""select page_id, rank, {SIGNATURE_JSON} as signature, count, first_node,
 tag || case when len(classes) > 0 then '.' || classes[1] else '' end as suggested_css from repeats where rank <= 40""",
        SIGNATURES,
    ),
)
def repeated_signatures(spark, sf_dir):
    return summary.repeated_signatures(pages(spark, sf_dir)).withColumn("signature", F.to_json("signature"))


# The list items of the navigation are one signature: li, no class, one child, a short text.
@query(
    "suggested_container",
    """select page_id, 'li' as suggested_css, max(n) as count from (
 select page_id, least(8, length(regexp_extract(x, '>([^<]*)<', 1)) // 30) as bucket, count(*) as n from (
  select page_id, unnest(regexp_extract_all(html, '<li><a[^>]*>[^<]*<')) as x from pages) group by all)
 group by page_id having max(n) >= 3""",
)
def suggested_container(spark, sf_dir):
    found = summary.suggested_container(pages(spark, sf_dir))
    return found.filter(F.col("suggested_css") == "li").select("page_id", "suggested_css", "count")


FIRST, MIDDLE, LAST = (fragment("r.page_id", f"r.ids[{i}]") for i in ("1", "count // 2 + 1", "count"))


@query(
    "signature_samples",
    tree(
        f"""select r.page_id, rank, {SIGNATURE_JSON} as signature, count, p.xpath as sample_xpath, to_json([{FIRST}, {MIDDLE}, {LAST}]) as sample_nodes
 from repeats r join paths p on p.page_id = r.page_id and p.nid = r.first_node where rank <= 40""",
        SIGNATURES,
        PATHS,
    ),
)
def signature_samples(spark, sf_dir):
    out = summary.signature_samples(pages(spark, sf_dir))
    return out.withColumn("signature", F.to_json("signature")).withColumn("sample_nodes", F.to_json("sample_nodes"))


@query(
    "clustered_subtrees",
    tree(
        """select r.page_id, rank, count, p.xpath as sample_xpath from repeats r
 join paths p on p.page_id = r.page_id and p.nid = r.first_node where rank <= 30""",
        SIGNATURES,
        PATHS,
    ),
)
def clustered_subtrees(spark, sf_dir):
    out = summary.clustered_subtrees(pages(spark, sf_dir))
    return out.select("page_id", "rank", "count", "sample_xpath")


@query(
    "longest_elements",
    tree(
        """select page_id, rank, length, xpath, preview from (select t.page_id, length(content) as length, xpath, content[:400] as preview,
  cast(row_number() over (partition by t.page_id order by length(content) desc, t.nid) as integer) as rank
  from texts t join paths p on p.page_id = t.page_id and p.nid = t.nid) where rank <= 20""",
        PATHS,
    ),
)
def longest_elements(spark, sf_dir):
    return summary.longest_elements(pages(spark, sf_dir))


@query(
    "sql_page_nodes",
    _with(
        """select tag, coalesce(attribute, '-') as attribute, count(*) as count from tags left join (
 select page_id, i, attribute from attrs) using (page_id, i) group by all""",
        TAGS,
        ATTRS,
    ),
)
def sql_page_nodes(spark, sf_dir):
    """Tags and their attributes in SQL alone, over the table function."""
    table_functions.register(spark)
    return spark.sql(
        """select tag, coalesce(attribute, '-') as attribute, count(*) as count
 from {pages} p, lateral page_nodes(p.html) n lateral view outer explode(map_keys(n.attrs)) as attribute
 where kind = 'e' group by all""",
        pages=pages(spark, sf_dir),
    )


@query("element_paths", tree("select xpath, count(*) as pages from paths group by xpath", PATHS))
def element_paths(spark, sf_dir):
    rows = node_rows(parse_pages(pages(spark, sf_dir), texts=(), xpath=True))
    return rows.groupBy("xpath").agg(F.count(F.lit(1)).alias("pages"))


@query("navigation_items_html", """select page_id, unnest(regexp_extract_all(html, '<li><a[^>]*>[^<]*</a></li>')) as item from pages""")
def navigation_items_html(spark, sf_dir):
    from pagequarry.sources.parse import outer_html

    rows = node_rows(parse_pages(pages(spark, sf_dir), texts=(), source=True))
    return rows.filter("tag = 'li'").select("page_id", outer_html().alias("item"))


# -- navigation extraction ------------------------------------------------------------------------

NAVIGATION = {
    ANY_SITE: {
        "product_container": css("nav li"),
        "name": css("a"),
        "offers": (Rule("a", attribute="href"),),
        "rating": (Rule(".//a/text()", "xpath"),),
        "reviews": (Rule(".//a/@href", "xpath"),),
    }
}
ITEMS = """items as (select page_id, cast(i as integer) as "index", regexp_extract(x, '>([^<]*)<', 1) as label,
 regexp_extract(x, 'href="([^"]*)"', 1) as href from (
 select page_id, unnest(regexp_extract_all(html, '<a[^>]*>[^<]*<')) as x,
  generate_subscripts(regexp_extract_all(html, '<a[^>]*>[^<]*<'), 1) as i from pages))"""


@query(
    "navigation_links",
    _with(
        """select page_id, "index", label as name, href as offers, label as rating, href as reviews
 from items where length(label) >= 2""",
        ITEMS,
    ),
)
def navigation_links(spark, sf_dir):
    rows = extract_products(pages(spark, sf_dir).drop("url"), NAVIGATION)
    return rows.select("page_id", "index", "name", "offers", "rating", "reviews")


@query(
    "navigation_performance",
    _with(
        """select field, count(*) as total, count(v) as valid from (select * from items where length(label) >= 2)
 cross join lateral (values ('name', label), ('offers', href), ('current_price', null)) t(field, v) group by field""",
        ITEMS,
    ),
)
def navigation_performance(spark, sf_dir):
    rows = extract_products(pages(spark, sf_dir).drop("url"), NAVIGATION)
    return quality.field_performance(rows, (), ("name", "offers", "current_price")).select("field", "total", "valid")


# -- urls -----------------------------------------------------------------------------------------


@query(
    "url_parts",
    """select page_id, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') as is_absolute,
 regexp_extract(url, '://([^/?#]*)', 1) as authority,
 regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || '/x/' || page_id as joined
 from pages""",
)
def url_parts(spark, sf_dir):
    url = F.col("url")
    return pages(spark, sf_dir).select(
        "page_id",
        tx.is_absolute_url(url).alias("is_absolute"),
        tx.url_authority(url).alias("authority"),
        tx.join_root_relative(url, F.concat(F.lit("/x/"), F.col("page_id"))).alias("joined"),
    )


@query(
    "host_counts",
    "select regexp_extract(url, '://([^/?#]*)', 1) as host, count(*) as pages from pages group by 1",
)
def host_counts(spark, sf_dir):
    host = tx.url_authority(F.col("url")).alias("host")
    return pages(spark, sf_dir).groupBy(host).agg(F.count(F.lit(1)).alias("pages"))


# -- search ---------------------------------------------------------------------------------------


@query(
    "line_range",
    """select page_id, array_to_string(list_slice(string_split(html, chr(10)), 2, 3), chr(10)) as content,
 greatest(least(3, len(string_split(html, chr(10)))) - 1, 0) as lines_retrieved from pages""",
)
def line_range(spark, sf_dir):
    return search.line_range(pages(spark, sf_dir), 2, 3)


def _search_sql(table: str, key: str, text: str, needle: str, context: int) -> str:
    return f"""with lines as (select {key}, string_split({text}, chr(10)) as l from {table}),
 hits as (select {key}, l, i as line, row_number() over (partition by {key} order by i) as hit from (
  select {key}, l, unnest(range(1, len(l) + 1)) as i from lines) where contains(lower(l[i]), '{needle}'))
 select {key}, cast(hit as integer) as hit, cast(line as integer) as line,
  array_to_string(list_slice(l, greatest(line - {context}, 1), line + {context}), chr(10)) as content
 from hits where hit <= 5"""


@query("text_search_pages", _search_sql("pages", "page_id", "html", "the", 10))
def text_search_pages(spark, sf_dir):
    return search.text_search(pages(spark, sf_dir), "The")


@query("text_search_documents", _search_sql("documents", "doc_id", "text", "license", 2))
def text_search_documents(spark, sf_dir):
    return search.text_search(documents(spark, sf_dir), "License", "text", "doc_id", context=2)


LINE_OF = "1 + length(left(html, p - 1)) - length(replace(left(html, p - 1), chr(10), ''))"


@query(
    "css_search_links",
    f"""with hits as (select page_id, html, x, i, (list_sum(list_transform(list_slice(pre, 1, i), lambda y: length(y)))
   + coalesce(list_sum(list_transform(list_slice(all_x, 1, i - 1), lambda y: length(y))), 0) + 1)::bigint as p from (
  select page_id, html, string_split_regex(html, '<a href="[^"]*">[^<]*</a>') as pre,
   regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as all_x,
   unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) as x,
   generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) as i from pages))
 select page_id, cast(i as integer) as hit, cast({LINE_OF} as integer) as line, x as content from hits where i <= 5""",
)
def css_search_links(spark, sf_dir):
    return search.css_search(pages(spark, sf_dir), "nav li a[href]")


@query(
    "attribute_search_class",
    """select page_id, 1 as hit, x as content from (
 select page_id, regexp_extract(html, '<div class="ad">[^<]*</div>') as x from pages) where x <> ''""",
)
def attribute_search_class(spark, sf_dir):
    return search.attribute_search(pages(spark, sf_dir), "class=ad").drop("line")


@query(
    "read_html_envelope",
    _with(
        """select page_id, least(5, count(*)) as matches_found, 'attribute' as search_mode, 'href' as query
 from links group by page_id""",
        TAGS,
        LINKS,
    ),
)
def read_html_envelope(spark, sf_dir):
    out = search.read_html(pages(spark, sf_dir), attribute="href")
    return out.select("page_id", "matches_found", "search_mode", "query")


# -- documents ------------------------------------------------------------------------------------


def _pattern_sql(name: str) -> str:
    pattern, group = PATTERNS[name]
    escaped = pattern.replace("'", "''")
    return f"list_slice(regexp_extract_all(text, '{escaped}', {group}), 1, {EXAMPLE_CAP})"


@query(
    "text_patterns",
    "select doc_id, "
    + ", ".join(
        f"array_to_string({_pattern_sql(p)}, '|') as {p}, len({_pattern_sql(p)}) as {p}_count" for p in PATTERNS
    )
    + " from documents",
)
def text_patterns(spark, sf_dir):
    found = summary.text_patterns(documents(spark, sf_dir), keys=("doc_id",))
    return found.select("doc_id", *[joined(p).alias(p) for p in PATTERNS], *[f"{p}_count" for p in PATTERNS])


@query(
    "page_text_patterns",
    tree(
        "select page_id, "
        + ", ".join(f"len({_pattern_sql(p)}) as {p}_count" for p in PATTERNS)
        + f", array_to_string({_pattern_sql('phones')}, '|') as phones"
        + " from (select page_id, string_agg(text, ' ' order by nid) as text from nodes where kind = 't' group by page_id)"
    ),
)
def page_text_patterns(spark, sf_dir):
    found = summary.text_patterns(summary.page_text(pages(spark, sf_dir)))
    return found.select("page_id", *[f"{p}_count" for p in PATTERNS], joined("phones").alias("phones"))


@query(
    "document_top_words",
    """select lang, cast(rank as integer) as rank, word, count from (select *,
  row_number() over (partition by lang order by count desc, first) as rank from (
   select lang, lower(w) as word, count(*) as count, min(doc_id * 1000000 + i) as first from (
    select doc_id, lang, unnest(regexp_extract_all(text, '[A-Za-z0-9'']{2,}')) as w,
     generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9'']{2,}'), 1) as i from documents) group by all))
 where rank <= 50""",
)
def document_top_words(spark, sf_dir):
    return summary.top_words(documents(spark, sf_dir), F.col("text"), ("lang",), ("doc_id",))


@query(
    "content_report",
    f"""select doc_id, length(text) as length, case when length(text) > 5000 then 'Good' when length(text) > 1000
 then 'Moderate' else 'Low' end as content_quality,
 array_to_string(list_filter([{", ".join(repr(w) for w in SHOP_WORDS)}], lambda w: contains(lower(text), lower(w))), '|') as indicators_found
 from documents""",
)
def content_report(spark, sf_dir):
    out = search.content_report(documents(spark, sf_dir))
    return out.withColumn("indicators_found", joined("indicators_found"))


@query("cleaned_titles", r"""select page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1),
 '[\s\x{00A0}]+', ' ', 'g')), '') as title from pages""")
def cleaned_titles(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", tx.clean_text(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("title")
    )
