"""Structural summaries of pages, per page or over a whole corpus.

Counters take element rows (`node_rows(parse_pages(...))`). Reports on texts and repeated subtrees take pages: they need all of
a page's nodes at once, so they work on the page's node array, in the row that the parse gave, and shuffle nothing.
 `by` names the grouping columns:
("page_id",) for one summary per page, () for the corpus, or ("site",) and the like. Frequency lists
order by count, ties by first appearance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.patterns import (
    PATTERNS,
    SENSITIVE_TYPES,
    SESSION_NAME,
    WORD,
    pattern_examples,
    sensitive_name,
)
from pagequarry.functions.text import is_absolute_url, strip, url_authority
from pagequarry.operators.arrays import first, group_runs, keep, listed
from pagequarry.operators.frequent import most_frequent
from pagequarry.operators.intervals import enclosing
from pagequarry.sources.parse import class_tokens, classes, parse_pages
from pagequarry.sources.storage import cut

PAGE = ("page_id",)

# List lengths of the report.
TOP = {
    "tag": 10,
    "host": 10,
    "href": 30,
    "src": 30,
    "input_type": 30,
    "class": 50,
    "id": 50,
    "word": 50,
}
UNIQUE = {"tag": "unique_tags", "class": "unique_classes", "id": "unique_ids"}
SIGNATURES, REPORTED_SIGNATURES, CLUSTERS = 60, 40, 30
ATTRIBUTES, ATTRIBUTE_VALUES = 40, 10
LONGEST = 20
CONTAINER_TAGS = ("div", "li", "article", "section", "a")
PREVIEW = 400


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _set(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _href() -> Column:
    return strip(F.coalesce(_attr("href"), F.lit("")))


def _src() -> Column:
    return F.coalesce(_set(_attr("src")), _set(_attr("data-src")), _set(_attr("data-lazy-src")), F.lit(""))


# -- page metadata --------------------------------------------------------------------------------


def page_meta(pages: DataFrame) -> DataFrame:
    """size_bytes, title and charset, read off the html text without a parse."""
    title, charset = r"(?is)<title[^>]*>(.*?)</title>", r"(?i)<meta[^>]*charset=[\"']?([^\"'>\s]+)"
    html = F.col("html")
    return pages.select(
        "page_id",
        F.octet_length(html).alias("size_bytes"),
        F.when(html.rlike(title), strip(F.regexp_extract(html, title, 1))).alias("title"),
        F.nullif(F.regexp_extract(html, charset, 1), F.lit("")).alias("charset"),
    )


# -- counters -------------------------------------------------------------------------------------


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def counters(nodes: DataFrame, by: tuple[str, ...] = PAGE, more: dict[str, Column] | None = None) -> DataFrame:
    """Every plain count of the summary in one aggregate, and `more`; unused ones are pruned from the plan."""
    tag, href, src = F.col("tag"), _href(), _src()
    link, image, script = tag == "a", tag == "img", tag == "script"
    has_script_src = F.coalesce(_attr("src"), F.lit("")) != ""
    aggs = {
        "total_nodes": F.count(F.lit(1)),
        "max_dom_depth": F.max("depth"),
        **{f"h{i}": _count(tag == f"h{i}") for i in range(1, 7)},
        "links": _count(link),
        "empty_hrefs": _count(link & (href == "")),
        "external_links": _count(link & is_absolute_url(href)),
        "internal_links": _count(link & (href != "") & ~is_absolute_url(href)),
        "mailto_links": _count(link & F.lower(href).startswith("mailto:")),
        "tel_links": _count(link & F.lower(href).startswith("tel:")),
        "images": _count(image),
        "missing_alt": _count(image & (strip(F.coalesce(_attr("alt"), F.lit(""))) == "")),
        "external_images": _count(image & is_absolute_url(src)),
        "forms": _count(tag == "form"),
        "inputs": _count(tag == "input"),
        "selects": _count(tag == "select"),
        "textareas": _count(tag == "textarea"),
        "scripts": _count(script),
        "inline_scripts": _count(script & ~has_script_src),
        "external_scripts": _count(script & has_script_src),
        "stylesheets": _count(
            (tag == "link") & ((_attr("rel") == "stylesheet") | F.coalesce(_attr("href").contains(".css"), F.lit(False)))
        ),
        "style_blocks": _count(tag == "style"),
    }
    return nodes.groupBy(*by).agg(*[agg.alias(name) for name, agg in (aggs | (more or {})).items()])


def headings(nodes: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    return counters(nodes, by).select(*by, *[f"h{i}" for i in range(1, 7)])


def max_depth(nodes: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    return counters(nodes, by).select(*by, "max_dom_depth")


def link_stats(nodes: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    names = ("links", "empty_hrefs", "external_links", "internal_links", "mailto_links", "tel_links")
    return counters(nodes, by).select(*by, *names)


def image_stats(nodes: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    return counters(nodes, by).select(*by, "images", "missing_alt", "external_images")


def form_controls(nodes: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    return counters(nodes, by).select(*by, "forms", "inputs", "selects", "textareas")


def script_stats(nodes: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    names = ("scripts", "inline_scripts", "external_scripts", "stylesheets", "style_blocks")
    return counters(nodes, by).select(*by, *names)


# -- frequency lists ------------------------------------------------------------------------------


def _values(section: str) -> Column:
    """What one element adds to a frequency list, as an array."""
    tag, none = F.col("tag"), F.array().cast("array<string>")

    def when(test, value):
        return F.when(F.coalesce(test, F.lit(False)), F.array(value)).otherwise(none)

    if section == "tag":
        return F.array(tag)
    if section == "href":
        return when(tag == "a", _href())
    if section == "host":
        return when((tag == "a") & is_absolute_url(_href()), F.coalesce(url_authority(_href()), F.lit("")))
    if section == "src":
        return when(tag == "img", _src())
    if section == "input_type":
        return when(tag == "input", F.lower(F.coalesce(_set(_attr("type")), F.lit("text"))))
    if section == "class":
        return classes()
    if section == "id":
        return when(_attr("id") != "", _attr("id"))
    raise ValueError(section)


def _first(by: tuple[str, ...], *place: str) -> Column:
    """The first place (whole numbers from 0 on) of a group. Within a page it is the least of one number, which Spark keeps in a hash
    table; a least struct makes it sort the rows."""
    if "page_id" not in by:
        return F.min(F.struct("page_id", *place)).alias("first")
    number = F.col(place[0])
    for name in place[1:]:
        number = number.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(name).cast("decimal(10,0)")
    return F.struct("page_id", F.min(number).alias("place")).alias("first")


def frequencies(nodes: DataFrame, sections: tuple[str, ...], by: tuple[str, ...] = PAGE) -> DataFrame:
    """Long table (by, section, value, count, first) of every requested list in one aggregate."""

    def labelled(section: str) -> Column:
        return F.transform(
            _values(section), lambda v: F.struct(F.lit(section).alias("section"), v.alias("value"))
        )

    entries = [labelled(s) for s in sections]
    entry = F.concat(*entries) if len(entries) > 1 else entries[0]
    keys = list(dict.fromkeys((*by, "page_id")))
    return (
        nodes.select(*keys, "node_id", F.explode(entry).alias("e"))
        .groupBy(*by, F.col("e.section").alias("section"), F.col("e.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("count"), _first(by, "node_id"))
    )


def _keep_top(counts: DataFrame, keys: tuple[str, ...], limit: Column | int, order: list) -> DataFrame:
    """Ranks within groups; Spark prunes each task to the limit before it shuffles the ranks."""
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


def top_values(nodes: DataFrame, section: str, by: tuple[str, ...] = PAGE, n: int | None = None) -> DataFrame:
    """The n most frequent values of one list with their rank."""
    counts = frequencies(nodes, (section,), by)
    top = _keep_top(counts, (*by, "section"), n or TOP[section], [F.desc("count"), "first"])
    return top.select(*by, "rank", F.col("value").alias(section), "count")


def corpus_top_values(nodes: DataFrame, section: str, n: int | None = None) -> DataFrame:
    """The n most frequent values of one list over all pages, with their rank; only values that can be among them are shuffled."""
    entry = F.struct("page_id", "node_id")
    rows = nodes.select(F.explode(_values(section)).alias("value"), F.lit(1).cast("long").alias("n"), entry.alias("first"))
    top = most_frequent(cut(rows, "values"), ["value"], "first", n or TOP[section])
    return top.select("rank", F.col("value").alias(section), "count")


def unique_counts(nodes: DataFrame, sections: tuple[str, ...] = ("tag", "class", "id"), by: tuple[str, ...] = PAGE) -> DataFrame:
    """Number of different tags, classes and ids."""
    counts = frequencies(nodes, sections, by)
    return counts.groupBy(*by).agg(
        *[F.count_if(F.col("section") == s).alias(UNIQUE[s]) for s in sections]
    )


# -- text -----------------------------------------------------------------------------------------


def word_counts(rows: DataFrame, text: Column, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Lower-cased word frequencies with the first place of each word."""
    words = F.posexplode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("at", "w")
    keys = list(dict.fromkeys((*by, *order)))
    return (
        rows.select(*keys, words)
        .groupBy(*by, F.lower("w").alias("word"))
        .agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*order, "at")).alias("first"))
    )


def top_words(rows: DataFrame, text: Column, by: tuple[str, ...], order: tuple[str, ...], n: int = TOP["word"]) -> DataFrame:
    counts = word_counts(rows, text, by, order)
    return _keep_top(counts, by, n, [F.desc("count"), "first"]).select(*by, "rank", "word", "count")


WORD_LETTERS = WORD.partition("{")[0]


def _own_text(node: Column) -> Column:
    return (node["kind"] == "e") & F.coalesce(strip(node["text"]) != "", F.lit(False))


def text_pages(pages: DataFrame, **options) -> DataFrame:
    """Pages parsed to one row each, with the lengths of their elements' texts and the pieces to count words from."""
    return parse_pages(pages, **{"texts": ("raw",), "sizes": True, "words": WORD_LETTERS, "whole": True, **options})


def _preview(element: Column, raw: str = "raw") -> Column:
    """The first characters of an element's text; a character has four bytes at most."""
    size = F.least(element["trim_e"] - element["trim_s"], F.lit(4 * PREVIEW))
    return F.left(F.substr(F.col(raw), element["trim_s"] + 1, size).cast("string"), F.lit(PREVIEW))


def with_text_stats(parsed: DataFrame) -> DataFrame:
    """Rows of `text_pages` with the column `text`: text elements (those whose own first string is not blank), characters of
    their blank-joined texts, words, the longest text. The joined text is never built."""
    texts = F.transform(
        F.filter("nodes", _own_text),
        lambda n: F.struct(n["size"].alias("size"), (-n["node_id"]).alias("minus_id"), n["trim_s"].alias("trim_s"), n["trim_e"].alias("trim_e")),
    )
    rows = parsed.withColumn("texts", texts)
    rows = rows.withColumn("longest", F.array_max("texts"))
    rows = rows.withColumn("head", _preview(F.col("longest")))
    count = F.size("texts")
    long = lambda x: x.cast("long")
    chars = F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + long(t["size"])) + count - 1
    words = F.aggregate(
        "pieces", F.lit(0).cast("long"), lambda a, p: a + long(p["weight"]) * long(F.regexp_count(p["text"], F.lit(WORD)))
    )
    rows = rows.withColumn("words", words)
    size = F.col("longest.size")
    stats = F.struct(
        count.cast("long").alias("text_nodes"),
        chars.alias("total_text_chars"),
        F.col("words").alias("word_count"),
        size.alias("longest_text_node_length"),
        F.when(size > PREVIEW, F.concat("head", F.lit("..."))).otherwise(F.col("head")).alias("longest_text_node_preview"),
        (F.col("words") / count).alias("avg_words_per_text_node"),
    )
    return rows.withColumn("text", F.when(count > 0, stats)).drop("texts", "longest", "head", "words")


def text_stats(pages: DataFrame) -> DataFrame:
    """Per page with text elements their number, characters, words and longest text."""
    return keep(with_text_stats(text_pages(pages)), F.col("text").isNotNull()).select("page_id", "text.*")


def piece_words(parsed: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    """(by, word, count, first) over the texts of all text elements of rows of `text_pages`."""
    rows = parsed.select("page_id", *[c for c in by if c != "page_id"], F.explode("pieces").alias("p"))
    found = F.posexplode(F.regexp_extract_all("p.text", F.lit(WORD), F.lit(0))).alias("at", "w")
    # Owner and place in one number of 62 bits.
    return (
        rows.select("*", found)
        .select("*", "p.weight", (F.col("p.owner") * F.lit(1 << 31) + F.col("p.place")).alias("string"))
        .groupBy(*by, F.lower("w").alias("word"))
        .agg(F.sum("weight").alias("count"), _first(by, "string", "at"))
    )


def page_top_words(pages: DataFrame, n: int = TOP["word"]) -> DataFrame:
    top = _keep_top(piece_words(text_pages(pages, texts=())), PAGE, n, [F.desc("count"), "first"])
    return top.select("page_id", "rank", "word", "count")


def joined_strings() -> Column:
    """All strings of a page but comments, joined by blanks, from its node array."""
    strings = F.filter("nodes", lambda n: (n["kind"] == "t") & (n["text"] != ""))
    return F.array_join(F.transform(strings, lambda n: n["text"]), " ")


def page_text(pages: DataFrame) -> DataFrame:
    return parse_pages(pages, texts=(), whole=True).select("page_id", joined_strings().alias("text"))


def text_patterns(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Per text: the first 30 matches of each pattern and, counted after that cap, how many."""
    found = texts.select(*keys, *[pattern_examples(F.col(text), p).alias(p) for p in PATTERNS])
    return found.select("*", *[F.size(p).alias(f"{p}_count") for p in PATTERNS])


def with_longest(parsed: DataFrame, n: int = LONGEST) -> DataFrame:
    """Rows of `text_pages` (with paths) with the column `longest`: the n text elements with the longest text."""
    texts = F.transform(
        F.filter("nodes", _own_text),
        lambda x: F.struct(
            (-x["size"]).alias("minus"), x["node_id"].alias("node_id"), x["xpath"].alias("xpath"), x["trim_s"].alias("trim_s"), x["trim_e"].alias("trim_e")
        ),
    )
    rows = parsed.withColumn("longest_of", first(texts, n))
    shown = F.transform(
        "longest_of", lambda x: F.struct((-x["minus"]).alias("length"), x["xpath"].alias("xpath"), F.coalesce(_preview(x), F.lit("")).alias("preview"))
    )
    return rows.withColumn("longest", shown).drop("longest_of")


def longest_elements(pages: DataFrame, n: int = LONGEST) -> DataFrame:
    """Per page the n text elements with the longest text: length, path, preview."""
    rows = with_longest(text_pages(pages, xpath=True, words=None), n)
    return listed(rows, "longest", "page_id").select("page_id", "rank", "item.length", "item.xpath", "item.preview")


# -- repeated subtrees ----------------------------------------------------------------------------


def _signature(node: Column) -> Column:
    return F.struct(
        node["tag"].alias("tag"),
        F.sort_array(class_tokens(node["attrs"])).alias("classes"),
        node["child_count"].alias("child_count"),
        F.least(F.lit(8), F.floor(node["size"] / 30)).cast("int").alias("text_bucket"),
    )


def with_repeats(parsed: DataFrame) -> DataFrame:
    """Rows of `text_pages` with `members` (signature and id of every element, by signature) and `repeats`: the signatures that
    occur more than once, most frequent first, as struct(minus_count, first_node, signature, at), `at` in members. Rows that have both
    are left as they are."""
    if "members" in parsed.columns and "repeats" in parsed.columns:
        return parsed
    members = F.transform(
        F.filter("nodes", lambda n: n["kind"] == "e"), lambda n: F.struct(_signature(n).alias("signature"), n["node_id"].alias("id"))
    )
    rows = group_runs(parsed.withColumn("members", F.sort_array(members)), "members", "signature", "groups")
    repeated = F.transform(
        F.filter("groups", lambda g: g["count"] > 1),
        lambda g: F.struct(
            (-g["count"]).alias("minus_count"),
            F.get("members", g["at"])["id"].alias("first_node"),
            F.get("members", g["at"])["signature"].alias("signature"),
            g["at"].alias("at"),
        ),
    )
    return rows.withColumn("repeats", F.coalesce(F.sort_array(repeated), F.array().cast(_REPEATS))).drop("groups")


_REPEATS = (
    "array<struct<minus_count:int,first_node:int,"
    "signature:struct<tag:string,classes:array<string>,child_count:int,text_bucket:int>,at:int>>"
)


def signature_css(signature: Column) -> Column:
    """The signature's tag with its first class."""
    more = F.when(F.size(signature["classes"]) > 0, F.concat(F.lit("."), F.get(signature["classes"], F.lit(0)))).otherwise("")
    return F.concat(signature["tag"], more)


def signature_pages(pages: DataFrame, **options) -> DataFrame:
    return with_repeats(text_pages(pages, words=None, **options))


def repeated_signatures(pages: DataFrame, n: int = REPORTED_SIGNATURES) -> DataFrame:
    """Per page the signatures that occur more than once, most frequent first."""
    rows = signature_pages(pages).withColumn("top", F.slice("repeats", F.lit(1), F.lit(n)))
    signature = F.col("item.signature")
    return listed(rows, "top", "page_id").select(
        "page_id",
        "rank",
        signature.alias("signature"),
        (-F.col("item.minus_count")).cast("long").alias("count"),
        F.col("item.first_node").alias("first_node"),
        signature_css(signature).alias("suggested_css"),
    )


def repeat_totals(pages: DataFrame) -> DataFrame:
    """Per page the number of signatures that occur more than once."""
    return signature_pages(pages).select("page_id", F.size("repeats").cast("long").alias("total_repeated_signatures"))


def container_of(repeats: Column) -> Column:
    """The first frequent signature that looks like a listing item, out of those looked at; null without one."""
    fits = F.filter(
        F.slice(repeats, F.lit(1), F.lit(SIGNATURES)),
        lambda r: (r["minus_count"] <= -3) & r["signature"]["tag"].isin(*CONTAINER_TAGS),
    )
    return F.get(fits, F.lit(0))


def suggested_container(pages: DataFrame) -> DataFrame:
    """Per page the first frequent signature that looks like a listing item."""
    rows = keep(signature_pages(pages).withColumn("c", container_of(F.col("repeats"))), F.col("c").isNotNull())
    return rows.select(
        "page_id",
        "c.signature",
        (-F.col("c.minus_count")).cast("long").alias("count"),
        "c.first_node",
        signature_css(F.col("c.signature")).alias("suggested_css"),
    )


def _fragment(node: Column, source: str = "source") -> Column:
    return F.substr(F.col(source), node["source_s"] + 1, node["source_e"] - node["source_s"]).cast("string")


def samples_of(repeat: Column) -> Column:
    """Ids of the first, middle and last node of a repeated signature."""
    count = -repeat["minus_count"]
    return F.transform(
        F.array(F.lit(0), F.floor(count / 2).cast("int"), count - 1), lambda i: F.get(F.col("members"), repeat["at"] + i)["id"]
    )


def sampled(repeats: Column) -> Column:
    """Repeated signatures with the path of their first node and three fragments of page source, cut out of the page's own row."""
    node = lambda i: F.get(F.col("nodes"), i)
    return F.transform(
        repeats,
        lambda r: F.struct(
            r["signature"].alias("signature"),
            (-r["minus_count"]).cast("long").alias("count"),
            node(r["first_node"])["xpath"].alias("sample_xpath"),
            signature_css(r["signature"]).alias("suggested_css"),
            F.transform(samples_of(r), lambda i: _fragment(node(i))).alias("sample_nodes"),
        ),
    )


def signature_samples(pages: DataFrame, n: int = REPORTED_SIGNATURES) -> DataFrame:
    """Top signatures with three sample fragments (source text) and the path of the first."""
    rows = signature_pages(pages, xpath=True, source=True)
    rows = rows.withColumn("samples", sampled(F.slice("repeats", F.lit(1), F.lit(n))))
    names = ("signature", "count", "sample_xpath", "sample_nodes")
    return listed(rows, "samples", "page_id").select("page_id", "rank", *[f"item.{n}" for n in names])


def clustered_subtrees(pages: DataFrame) -> DataFrame:
    return signature_samples(pages, CLUSTERS)


# -- attributes -----------------------------------------------------------------------------------


def attribute_counts(nodes: DataFrame, by: tuple[str, ...] = PAGE, n: int = ATTRIBUTES) -> DataFrame:
    """Per tag the most frequent attributes."""
    keys = list(dict.fromkeys((*by, "page_id")))
    rows = nodes.select(*keys, "tag", "node_id", F.posexplode(F.map_keys("attrs")).alias("at", "attribute"))
    counts = rows.groupBy(*by, "tag", "attribute").agg(
        F.count(F.lit(1)).alias("count"), _first(by, "node_id", "at")
    )
    top = _keep_top(counts, (*by, "tag"), n, [F.desc("count"), "first"])
    return top.select(*by, "tag", "rank", "attribute", "count")


def attribute_values(nodes: DataFrame, by: tuple[str, ...] = PAGE, n: int = ATTRIBUTE_VALUES) -> DataFrame:
    """Per tag and attribute the most frequent non-empty values."""
    keys = list(dict.fromkeys((*by, "page_id")))
    rows = nodes.select(*keys, "tag", "node_id", F.explode("attrs").alias("attribute", "value"))
    counts = (
        rows.filter(F.col("value") != "")
        .groupBy(*by, "tag", "attribute", "value")
        .agg(F.count(F.lit(1)).alias("count"), _first(by, "node_id"))
    )
    top = _keep_top(counts, (*by, "tag", "attribute"), n, [F.desc("count"), "first"])
    return top.select(*by, "tag", "attribute", "rank", "value", "count")


# -- forms ----------------------------------------------------------------------------------------


def forms(nodes: DataFrame) -> DataFrame:
    """One row per form: action, method, redacted inputs, login and external flags. Raw values never
    leave the parse: they are replaced before anything is shuffled."""
    tag = F.col("tag")
    control = tag.isin("input", "textarea", "select")
    named = strip(F.coalesce(_set(_attr("name")), _attr("id"), F.lit("")))
    kind = F.lower(F.coalesce(_set(_attr("type")), tag))
    filled = strip(F.coalesce(_attr("value"), F.lit(""))) != ""
    suspicious = (
        sensitive_name(named) | kind.isin(*SENSITIVE_TYPES) | F.lower(named).rlike(SESSION_NAME)
    )
    entry = F.struct(
        F.col("node_id").alias("node_id"),
        named.alias("name"),
        kind.alias("type"),
        filled.alias("has_value"),
        F.when(filled, F.when(suspicious, "REDACTED").otherwise("<<non-sensitive>>")).alias("redacted_value"),
        suspicious.alias("suspicious"),
    )
    action = strip(F.coalesce(_attr("action"), F.lit("")))
    rows = nodes.filter((tag == "form") | control).select(
        "page_id",
        "node_id",
        "end_id",
        (tag == "form").alias("is_form"),
        control.alias("is_input"),
        action.alias("action"),
        F.upper(F.coalesce(_set(_attr("method")), F.lit("GET"))).alias("method"),
        F.when(control, entry).alias("entry"),
    )
    owned = enclosing(rows, "is_form", "is_input", ["entry"], own=("action", "method"))
    found = owned.groupBy("page_id", "box_id").agg(
        F.array_sort(F.collect_list("entry")).alias("inputs"),
        F.max("action").alias("action"),
        F.max("method").alias("method"),
    )
    low = lambda i: F.lower(i["name"])
    has_password = F.exists("inputs", lambda i: (i["type"] == "password") | low(i).contains("pass"))
    has_user = F.exists("inputs", lambda i: low(i).contains("user") | low(i).contains("email"))
    has_text = F.exists("inputs", lambda i: i["type"] == "text")
    return (
        found.select(
            "page_id",
            F.col("box_id").alias("form_id"),
            "action",
            "method",
            is_absolute_url(F.col("action")).alias("external_action"),
            F.size("inputs").alias("input_count"),
            F.transform("inputs", lambda i: i.dropFields("node_id")).alias("inputs"),
            (has_password & (has_user | has_text)).alias("likely_login_form"),
        )
    )


def form_flags(nodes: DataFrame) -> DataFrame:
    """Per page: any form posting to an absolute address, any login form."""
    return forms(nodes).groupBy("page_id").agg(
        F.bool_or("external_action").alias("has_forms_posting_external"),
        F.bool_or("likely_login_form").alias("has_login_form"),
    )


# -- confidence -----------------------------------------------------------------------------------


def confidence(nodes: DataFrame, by: tuple[str, ...] = PAGE) -> DataFrame:
    """How much of a page its scripts are likely to build."""
    names = ("total_nodes", "scripts", "inline_scripts", "links", "empty_hrefs")
    if "page_id" in by:
        # A page's own classes: no longer than the page, so they are gathered in the same aggregate.
        unique = F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.size(classes()) > 0, classes())))))
        joined = counters(nodes, by, {"unique_classes": unique}).select(*by, *names, "unique_classes")
    else:
        counts = counters(nodes, by).select(*by, *names)
        unique = unique_counts(nodes, ("class",), by)
        joined = counts.join(unique, list(by), "left") if by else counts.withColumn("unique_classes", unique.scalar())
    many = F.coalesce(F.col("unique_classes"), F.lit(0)) > 100
    score = F.least(
        F.lit(1.0),
        F.col("scripts") / F.greatest(F.lit(1), F.col("total_nodes")) * 10
        + F.col("inline_scripts") / (F.col("scripts") + 1),
    )
    empty = F.col("empty_hrefs") / F.greatest(F.lit(1), F.col("links"))
    return joined.select(
        *by,
        F.round(score, 3).alias("js_score"),
        F.round(empty, 3).alias("empty_anchor_ratio"),
        many.alias("lots_of_classes"),
        ((score > 0.05) | (empty > 0.2) | many).alias("is_likely_js_heavy"),
    )
