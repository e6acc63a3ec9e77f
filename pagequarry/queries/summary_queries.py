"""The assembled page summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.plans import summarize as plan
from pagequarry.queries.page_queries import ATTRS, CLASSES, TAGS, pages
from pagequarry.queries.registry import query
from pagequarry.queries.tree_sql import PATHS, SIGNATURES, tree
from pagequarry.sources import sinks
from pagequarry.sources.storage import new_folder


def _with(sql: str, *ctes: str) -> str:
    return "with " + ", ".join(ctes) + " " + sql


@query(
    "page_summary",
    _with(
        """select p.page_id, octet_length(encode(html)) as size_bytes, total_nodes, unique_tags, links, unique_classes,
 tops from pages p join (
  select page_id, count(*) as total_nodes, count(distinct tag) as unique_tags, count(*) filter (where tag = 'a') as links
  from tags group by page_id) using (page_id)
 join (select page_id, count(distinct class) as unique_classes from tokens group by page_id) using (page_id)
 join (select page_id, string_agg(tag || '=' || n, ',' order by n desc, f) as tops from (
  select *, row_number() over (partition by page_id order by n desc, f) as r from (
   select page_id, tag, count(*) as n, min(i) as f from tags group by all)) where r <= 10 group by page_id) using (page_id)""",
        TAGS,
        ATTRS,
        CLASSES,
    ),
)
def page_summary(spark, sf_dir):
    rows = plan.summarize(pages(spark, sf_dir), keys=("top_tag",))
    entry = lambda t: F.concat(t["value"], F.lit("="), t["count"])
    return rows.select(
        "page_id",
        "size_bytes",
        "total_nodes",
        "unique_tags",
        "links",
        "unique_classes",
        F.array_join(F.transform("top_tag", entry), ",").alias("tops"),
    )


@query(
    "page_summary_structure",
    tree(
        """select page_id, text_nodes, total_text_chars, word_count, total_repeated_signatures, container, container_count, words, repeats, paths, attributes
 from (select page_id, count(*) as text_nodes, cast(sum(length(content)) + count(*) - 1 as bigint) as total_text_chars,
   cast(sum(len(regexp_extract_all(content, '[A-Za-z0-9'']{2,}'))) as bigint) as word_count from texts group by page_id)
 join (select page_id, count(*) as total_repeated_signatures, arg_min(css, rank) filter (where fits) as container,
   arg_min(count, rank) filter (where fits) as container_count,
   string_agg(css || '=' || count || '@' || xpath, ',' order by rank) filter (where rank <= 40) as repeats from (
    select r.*, xpath, r.tag || case when len(classes) > 0 then '.' || classes[1] else '' end as css,
     rank <= 60 and count >= 3 and r.tag in ('div', 'li', 'article', 'section', 'a') as fits
    from repeats r join paths p on p.page_id = r.page_id and p.nid = r.first_node) group by page_id) using (page_id)
 join (select page_id, string_agg(word || '=' || n, ',' order by n desc, first) as words from (
   select *, row_number() over (partition by page_id order by n desc, first) as rank from (
    select page_id, lower(w) as word, count(*) as n, min(nid * 100000 + i) as first from (
     select page_id, nid, unnest(l) as w, generate_subscripts(l, 1) as i from (
      select page_id, nid, regexp_extract_all(content, '[A-Za-z0-9'']{2,}') as l from texts)) group by all)) where rank <= 50 group by page_id) using (page_id)
 join (select page_id, string_agg(xpath || '=' || n, ',' order by rank) as paths from (
   select t.page_id, length(content) as n, xpath, row_number() over (partition by t.page_id order by length(content) desc, t.nid) as rank
   from texts t join paths p on p.page_id = t.page_id and p.nid = t.nid) where rank <= 20 group by page_id) using (page_id)
 join (select page_id, string_agg(tag || '.' || attribute || '=' || n || ':' || best, ',' order by tag, n desc, first) as attributes from (
   select page_id, tag, attribute, sum(n)::bigint as n, min(first) as first, coalesce(arg_max(value, n * 1000000 - first) filter (where value <> ''), '') as best from (
    select page_id, tag, attribute, value, count(*) as n, min(i * 1000 + j) as first from attrs group by all) group by all) group by page_id) using (page_id)""",
        SIGNATURES,
        PATHS,
        TAGS,
        ATTRS,
    ),
)
def page_summary_structure(spark, sf_dir):
    """The keys on texts, repeated subtrees, paths and attributes."""
    rows = plan.summarize(pages(spark, sf_dir))

    def told(name: str, entry):
        return F.array_join(F.transform(name, entry), ",")

    value = lambda a: F.coalesce(F.get(a["top_values"], F.lit(0))["value"], F.lit(""))
    return rows.select(
        "page_id",
        "text_nodes",
        "total_text_chars",
        "word_count",
        "total_repeated_signatures",
        F.col("suggested_container.suggested_css").alias("container"),
        F.col("suggested_container.count").alias("container_count"),
        told("top_words", lambda w: F.concat(w["word"], F.lit("="), w["count"])).alias("words"),
        told("top_repeated", lambda r: F.concat(r["suggested_css"], F.lit("="), r["count"], F.lit("@"), r["sample_xpath"])).alias("repeats"),
        told("top_xpath_examples", lambda x: F.concat(x["xpath"], F.lit("="), x["length"])).alias("paths"),
        told("attribute_stats", lambda a: F.concat(a["tag"], F.lit("."), a["attribute"], F.lit("="), a["count"], F.lit(":"), value(a))).alias("attributes"),
    )


@query("page_summary_json")
def page_summary_json(spark, sf_dir):
    path = new_folder(spark, "summaries")
    sinks.export_json(plan.summarize(pages(spark, sf_dir)), path, by=None, compression="gzip")
    return spark.read.text(path)


@query(
    "reduced_summary",
    _with(
        """select page_id, count(*) filter (where tag = 'a') as links, count(*) filter (where tag = 'h1') as h1,
 false as is_likely_js_heavy from tags group by page_id""",
        TAGS,
    ),
)
def reduced_summary(spark, sf_dir):
    return plan.reduced(plan.summarize(pages(spark, sf_dir), keys=plan.REDUCED)).select(
        "page_id", "links", "h1", "is_likely_js_heavy"
    )


@query("summary_field", "select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as value from pages")
def summary_field(spark, sf_dir):
    return plan.read_field(plan.summarize(pages(spark, sf_dir), keys=("title",)), "title")
