"""The whole structural summary of each page as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.patterns import PATTERNS, pattern_examples
from pagequarry.operators import summary
from pagequarry.operators.heuristics import FIELDS, HINTS, sample_extractions
from pagequarry.sources.parse import node_rows, parse_pages
from pagequarry.sources.storage import cut

LISTS = ("tag", "host", "href", "src", "input_type", "class", "id")

# Keys that are read off a page's whole node array.
FROM_ARRAY = (
    "text_nodes", "total_text_chars", "word_count", "longest_text_node_length", "longest_text_node_preview", "avg_words_per_text_node",
    "total_repeated_signatures", "top_repeated", "clustered_subtrees", "suggested_container", "top_xpath_examples", "top_words",
    "sample_extractions", *PATTERNS, *(f"{p}_count" for p in PATTERNS),
)

# The texts of a stored page.
STORED_TEXTS = ("source", "raw", "stripped")

# What the aggregates need of an element.
ELEMENT = ("node_id", "end_id", "depth", "tag", "attrs", "child_count")

# The keys a reduced summary keeps.
REDUCED = (
    "page_id",
    "size_bytes",
    "title",
    "charset",
    "total_nodes",
    "unique_tags",
    *(f"h{i}" for i in range(1, 7)),
    "links",
    "empty_hrefs",
    "external_links",
    "images",
    "missing_alt",
    "unique_classes",
    "unique_ids",
    "top_tag",
    "top_href",
    "top_src",
    "top_class",
    "top_id",
)


def summarize(pages: DataFrame, top_tags: int = summary.TOP["tag"], keys: tuple[str, ...] | None = None) -> DataFrame:
    """One row per page with content, with every key of the report, or with those of `keys` besides the plain counts.

    The pages are parsed once, into the shared folder. What a page's own node array can tell is told in its row (texts, repeated
    subtrees, fragments, patterns); counts and lists are aggregates over the element rows, which go to the task of their page
    once for all of them. Parts without a wanted key are not made.
    """
    pages = pages.select("page_id", *(["url"] if "url" in pages.columns else []), "html")

    def wanted(*names: str) -> bool:
        return keys is None or any(k in names for k in keys)

    parts = []
    if wanted(*FROM_ARRAY):
        parsed = summary.text_pages(pages, texts=("raw", "stripped"), xpath=True, source=True, longest=True).filter("parse_error is null")
        # The facts and the samples both start from the repeated subtrees.
        parsed = _stored(summary.with_repeats(parsed))
        elements = _elements(parsed)
        parts += [_facts(parsed), _words(parsed), _samples(pages, parsed)]
    else:
        elements = cut(node_rows(parse_pages(pages, texts=())).select("page_id", *ELEMENT), "elements")
    out = summary.page_meta(pages).join(summary.counters(elements), "page_id")
    if wanted(*[f"top_{name}" for name in LISTS], *summary.UNIQUE.values()):
        parts.append(_lists(elements, top_tags))
    if wanted("js_score", "empty_anchor_ratio", "lots_of_classes", "is_likely_js_heavy"):
        parts.append(summary.confidence(elements))
    if wanted("attribute_stats"):
        parts.append(_attributes(elements))
    if wanted("forms_detailed", "has_forms_posting_external"):
        parts.append(_forms(elements))
    for part in parts:
        out = out.join(part, "page_id", "left")
    # The first of the samples: made before the joins, they would be shuffled twice.
    clusters = F.slice("top_repeated", F.lit(1), F.lit(summary.CLUSTERS)).alias("clustered_subtrees")
    out = out.select(*[x for c in out.columns for x in ((c, clusters) if c == "top_repeated" else (c,))])
    if "has_forms_posting_external" in out.columns:
        out = out.withColumn("has_forms_posting_external", F.coalesce("has_forms_posting_external", F.lit(False)))
    hints = F.create_map(*[x for field, hints in HINTS.items() for x in (F.lit(field), F.array(*[F.lit(h) for h in hints]))])
    return out.withColumn("field_hint_map", hints) if wanted("field_hint_map") else out


def _stored(parsed: DataFrame) -> DataFrame:
    """Parsed pages, stored with their three texts in one cell: these hold the same strings, which then take little more than once
    their space. Read back they are columns of their own again."""
    sizes = [F.octet_length(t).alias(f"{t}_bytes") for t in STORED_TEXTS]
    rows = parsed.select(*[c for c in parsed.columns if c not in STORED_TEXTS], F.concat(*STORED_TEXTS).alias("packed"), *sizes)
    rows, start, texts = cut(rows, "parsed", compression="zstd"), F.lit(1), []
    for t in STORED_TEXTS:
        texts.append(F.substr(F.col("packed"), start, F.col(f"{t}_bytes")).alias(t))
        start = start + F.col(f"{t}_bytes")
    return rows.select(*[c for c in parsed.columns if c not in STORED_TEXTS], *texts)


def _elements(parsed: DataFrame) -> DataFrame:
    """Element rows of stored pages. The pages' arrays are shuffled, by page: counts of a page's elements need no more shuffles."""
    nodes = F.arrays_zip(*[F.col(f"nodes.{c}").alias(c) for c in ("kind", *ELEMENT)])
    elements = F.transform(F.filter(nodes, lambda n: n["kind"] == "e"), lambda n: F.struct(*[n[c].alias(c) for c in ELEMENT]))
    return parsed.select("page_id", elements.alias("elements")).repartition("page_id").select("page_id", F.inline("elements"))


def _facts(parsed: DataFrame) -> DataFrame:
    """What is read off a page's own node array."""
    rows = summary.with_longest(summary.with_repeats(summary.with_text_stats(parsed)))
    rows = rows.withColumn("all_text", summary.joined_strings())
    found = {p: pattern_examples(F.col("all_text"), p) for p in PATTERNS}
    rows = rows.withColumns(found).withColumn("samples", summary.sampled(F.slice("repeats", F.lit(1), F.lit(summary.REPORTED_SIGNATURES))))
    rows = rows.withColumn("container", summary.container_of(F.col("repeats")))
    container = F.col("container")
    best = F.struct(
        container["signature"].alias("signature"),
        (-container["minus_count"]).cast("long").alias("count"),
        summary.signature_css(container["signature"]).alias("suggested_css"),
    )
    return rows.select(
        "page_id",
        "text.*",
        F.size("repeats").cast("long").alias("total_repeated_signatures"),
        F.col("samples").alias("top_repeated"),
        F.when(container.isNotNull(), best).alias("suggested_container"),
        F.col("longest").alias("top_xpath_examples"),
        *PATTERNS,
        *[F.size(p).alias(f"{p}_count") for p in PATTERNS],
    )


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """A page's ranked rows as one array."""
    entries = F.sort_array(F.collect_list(F.struct("rank", *columns)))
    return rows.groupBy("page_id").agg(F.transform(entries, lambda e: e.dropFields("rank")).alias(name))


def _words(parsed: DataFrame) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy(F.desc("count"), "first")
    # As for the elements, the pages' texts are shuffled instead of their many different words.
    texts = parsed.select("page_id", "pieces").repartition("page_id")
    ranked = summary.piece_words(texts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= summary.TOP["word"])
    return _listed(ranked, "top_words", "word", "count")


def _attributes(elements: DataFrame) -> DataFrame:
    """The most frequent attributes of each tag with their most frequent values."""
    values = summary.attribute_values(elements)
    values = values.groupBy("page_id", "tag", "attribute").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))), lambda e: e.dropFields("rank")).alias("top_values")
    )
    # Joined by page, as everything else is: joined by attribute, both sides would be shuffled again.
    of_page = F.map_from_entries(F.collect_list(F.struct(F.struct("tag", "attribute"), "top_values")))
    values = values.groupBy("page_id").agg(of_page.alias("values"))
    entries = F.sort_array(F.collect_list(F.struct("tag", "rank", "attribute", "count")))
    counts = summary.attribute_counts(elements).groupBy("page_id").agg(entries.alias("entries")).join(values, "page_id", "left")
    top_values = lambda e: F.element_at("values", F.struct(e["tag"], e["attribute"])).alias("top_values")
    stats = F.transform("entries", lambda e: F.struct(e["tag"], e["attribute"], e["count"], top_values(e)))
    return counts.select("page_id", stats.alias("attribute_stats"))


def _forms(elements: DataFrame) -> DataFrame:
    entry = F.struct("form_id", "action", "method", "external_action", "input_count", "inputs", "likely_login_form")
    return summary.forms(elements).groupBy("page_id").agg(
        F.sort_array(F.collect_list(entry)).alias("forms_detailed"),
        F.bool_or("external_action").alias("has_forms_posting_external"),
    )


def _samples(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    rows = sample_extractions(pages, parsed=parsed.drop("pieces"))
    entries = F.sort_array(F.collect_list(F.struct("rank", "nth", "signature", *FIELDS)))
    return rows.groupBy("page_id").agg(entries.alias("sample_extractions"))


def _lists(elements: DataFrame, top_tags: int) -> DataFrame:
    """Every frequency list and unique count from one aggregate."""
    counts = summary.frequencies(elements, LISTS)
    limits = {**summary.TOP, "tag": top_tags}
    limit = F.lit(0)
    for name in LISTS:
        limit = F.when(F.col("section") == name, limits[name]).otherwise(limit)
    order = Window.partitionBy("page_id", "section").orderBy(F.desc("count"), "first")
    ranked = counts.withColumn("rank", F.row_number().over(order))

    def top(name: str) -> Column:
        mine = (F.col("section") == name) & (F.col("rank") <= limit)
        entry = F.when(mine, F.struct("rank", "value", "count"))
        listed = F.sort_array(F.collect_list(entry))
        return F.transform(listed, lambda e: e.dropFields("rank")).alias(f"top_{name}")

    return ranked.groupBy("page_id").agg(
        *[top(name) for name in LISTS],
        *[F.count_if(F.col("section") == s).alias(n) for s, n in summary.UNIQUE.items()],
    )


def reduced(summaries: DataFrame) -> DataFrame:
    """The fewer keys of a summary without structure analysis; never marked script-heavy."""
    return summaries.select(*REDUCED, F.lit(False).alias("is_likely_js_heavy"))


def field_names(summaries: DataFrame) -> list[str]:
    return [c for c in summaries.columns if c != "page_id"]


def read_field(summaries: DataFrame, name: str) -> DataFrame:
    """One key of each summary; an unknown key gives a message that lists the known ones."""
    if name in field_names(summaries):
        return summaries.select("page_id", F.col(name).alias("value"))
    known = ", ".join(field_names(summaries))
    return summaries.select("page_id", F.lit(f"Field '{name}' not found. Available fields: {known}").alias("value"))
