"""Looking into pages: line ranges, css, text and attribute search, selector probes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.patterns import SHOP_WORDS, content_quality, shop_words_found
from pagequarry.operators import structure
from pagequarry.operators.selectors import Path, Selector, Test, compile_css, literal
from pagequarry.sources.parse import node_rows, node_text, outer_html, parse_pages

# Result and context sizes of a search.
MAX_RESULTS, CONTEXT_LINES = 5, 10

# Container selectors worth probing, and what is sampled inside the first hit.
PROBED = ("div[data-id]", "div.cPHDOP", "div.slAVV4", "div._75nlfW", "div.tUxRFH")
PROBED_PRICES = ('div[class*="price"]', 'span[class*="price"]')
PROBED_NAMES = ("a[title]", 'div[class*="title"]')
PROBED_TAGS = 20


def line_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start..end (1-based, inclusive, clamped) of each page."""
    lines = F.split("html", "\n")
    first = max(start, 1)
    count = F.greatest(F.least(F.lit(end), F.size(lines)) - first + 1, F.lit(0))
    return pages.select(
        "page_id",
        F.array_join(F.slice(lines, first, count), "\n").alias("content"),
        count.alias("lines_retrieved"),
    )


def text_search(
    texts: DataFrame,
    needle: str,
    text: str = "html",
    key: str = "page_id",
    max_results: int = MAX_RESULTS,
    context: int = CONTEXT_LINES,
) -> DataFrame:
    """First lines holding a text (any case), each with the lines around it. Row-local: the lines of
    a page never leave its row."""
    wanted = F.lower(F.lit(needle))
    has_any = F.contains(F.lower(F.col(text)), wanted)
    lines = F.col("lines")
    numbered = F.transform(
        lines, lambda line, i: F.when(F.contains(F.lower(line), wanted), i + 1)
    )
    hits = F.slice(F.array_compact(numbered), 1, max_results)
    found = (
        texts.filter(has_any)
        .select(key, F.split(text, "\n").alias("lines"))
        .select(key, "lines", F.posexplode(hits).alias("at", "line"))
    )
    first = F.greatest(F.col("line") - context, F.lit(1))
    around = F.slice(lines, first, F.col("line") + context - first + 1)
    return found.select(
        key, (F.col("at") + 1).alias("hit"), "line", F.array_join(around, "\n").alias("content")
    )


def _whole_paths(rows: DataFrame, paths: tuple[Path, ...], names: dict[Test, str], prefix: str) -> tuple[DataFrame, Column]:
    """Rows with a column per step that has ancestors, and whether any of the paths ends at a row."""
    finals = []
    for i, path in enumerate(paths):
        flag = F.col(names[path.steps[0]])
        for at, join in enumerate(path.joins):
            related = structure.follows if join == "+" else structure.inside
            name = f"{prefix}{i}_{at}"
            rows = rows.withColumn(name, F.col(names[path.steps[at + 1]]) & related(flag))
            flag = F.col(name)
        finals.append(flag)
    return rows, reduce(Column.__or__, finals)


def _matches(nodes: DataFrame, selector: Selector, columns: dict[str, Column]) -> DataFrame:
    """Rows matching a css selector. `columns` are cut out of matching rows before any shuffle, and
    a selector of single steps needs none."""
    ends = " or ".join(p.steps[-1].sql() for p in selector.paths)
    if all(len(p.steps) == 1 for p in selector.paths):
        return nodes.filter(F.expr(ends)).select(
            "page_id", "node_id", *[c.alias(n) for n, c in columns.items()]
        )
    tests = list(dict.fromkeys(t for p in selector.paths for t in p.steps))
    names = {t: f"t{i}" for i, t in enumerate(tests)}
    rows = nodes.filter(F.expr(" or ".join(t.sql() for t in tests))).select(
        "page_id",
        "node_id",
        "end_id",
        "parent_id",
        "sib_idx",
        *[F.expr(t.sql()).alias(n) for t, n in names.items()],
        *[F.when(F.expr(ends), c).alias(n) for n, c in columns.items()],
    )
    rows, flag = _whole_paths(rows, selector.paths, names, "p")
    return rows.filter(flag).select("page_id", "node_id", *columns)


def _first_per_page(hits: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy("node_id")
    return hits.withColumn("hit", F.row_number().over(order)).filter(F.col("hit") <= n)


def css_search(pages: DataFrame, css: str, max_results: int = MAX_RESULTS) -> DataFrame:
    """First matching elements per page: source text and the line they start on."""
    nodes = node_rows(parse_pages(pages, texts=("stripped",), source=True))
    hits = _matches(nodes, compile_css(css, lists=True), {"line": F.col("line"), "content": outer_html()})
    return _first_per_page(hits, max_results).select("page_id", "hit", "line", "content")


def css_counts(pages: DataFrame, selectors: tuple[str, ...]) -> DataFrame:
    """Hits per page and candidate selector, with the first hit's class and data-id. All selectors are flags of one pass."""
    nodes = node_rows(parse_pages(pages, texts=("stripped",)))
    paths = [compile_css(css, lists=True).paths for css in selectors]
    tests = list(dict.fromkeys(t for some in paths for p in some for t in p.steps))
    names = {t: f"t{i}" for i, t in enumerate(tests)}
    cells = [F.col("attrs")[name].alias(alias) for name, alias in (("class", "class"), ("data-id", "data_id"))]
    rows = nodes.filter(F.expr(" or ".join(t.sql() for t in tests))).select(
        "page_id", "node_id", "end_id", "parent_id", "sib_idx", *cells, *[F.expr(t.sql()).alias(n) for t, n in names.items()]
    )
    hits = []
    for i, (css, some) in enumerate(zip(selectors, paths)):
        rows, flag = _whole_paths(rows, some, names, f"s{i}_")
        hits.append(F.when(flag, F.lit(css)))
    found = rows.select("page_id", "node_id", "class", "data_id", F.explode(F.array_compact(F.array(*hits))).alias("selector"))
    return found.groupBy("page_id", "selector").agg(
        F.count(F.lit(1)).alias("elements"),
        F.min_by("class", "node_id").alias("sample_class"),
        F.min_by("data_id", "node_id").alias("sample_data_id"),
    )


def attribute_search(pages: DataFrame, wanted: str, max_results: int = MAX_RESULTS) -> DataFrame:
    """`attr` or `attr=value`; a class value also matches one token."""
    name, _, value = (part.strip() for part in wanted.partition("="))
    nodes = node_rows(parse_pages(pages, texts=(), source=True))
    cell = F.col("attrs")[name.lower()]
    test = cell.isNotNull()
    if value:
        test = cell == value
        if name.lower() == "class":
            padded = F.concat(F.lit(" "), cell, F.lit(" "))
            test = test | F.contains(padded, F.lit(f" {value} "))
    hits = nodes.filter(test).select("page_id", "node_id", "line", outer_html().alias("content"))
    return _first_per_page(hits, max_results).select("page_id", "hit", "line", "content")


def read_html(
    pages: DataFrame,
    start_line: int | None = None,
    end_line: int | None = None,
    css_selector: str | None = None,
    text: str | None = None,
    attribute: str | None = None,
    max_results: int = MAX_RESULTS,
    context: int = CONTEXT_LINES,
) -> DataFrame:
    """One search per call: a full line range wins, then css, text, attribute. Per page: content,
    matches_found, match_positions, search_mode, query."""
    mode = "css_selector" if css_selector else "text_search" if text else "attribute" if attribute else "line_range"
    asked = css_selector or text or attribute
    if start_line is not None and end_line is not None:
        return line_range(pages, start_line, end_line).withColumn("search_mode", F.lit(mode))
    if mode == "line_range":
        raise ValueError("give a line range, a selector, a text or an attribute")
    if mode == "css_selector":
        hits = css_search(pages, css_selector, max_results)
    elif mode == "text_search":
        hits = text_search(pages, text, max_results=max_results, context=context).withColumn(
            "content", F.concat(F.lit("Line "), "line", F.lit(":\n"), "content")
        )
    else:
        hits = attribute_search(pages, attribute, max_results)
    listed = F.array_sort(F.collect_list(F.struct("hit", "line", "content")))
    grouped = hits.groupBy("page_id").agg(listed.alias("h"))
    empty = F.lit(f"No matches found for: {asked}")
    return pages.select("page_id").join(grouped, "page_id", "left").select(
        "page_id",
        F.coalesce(
            F.array_join(F.transform("h", lambda x: x["content"]), "\n\n---\n\n"), empty
        ).alias("content"),
        F.coalesce(F.size("h"), F.lit(0)).alias("matches_found"),
        F.coalesce(F.transform("h", lambda x: x["line"]), F.array().cast("array<int>")).alias("match_positions"),
        F.lit(mode).alias("search_mode"),
        F.lit(asked).alias("query"),
    )


def container_probe(pages: DataFrame, container: str = PROBED[0]) -> DataFrame:
    """Per page, inside the first element matching `container`: its first 20 tags, and up to three
    price and two name elements."""
    nodes = node_rows(parse_pages(pages, texts=("stripped",)))
    box = compile_css(container, lists=True).paths[0].steps[0].sql()
    prices = [compile_css(c).paths[0].steps[0].sql() for c in PROBED_PRICES]
    names = [compile_css(c).paths[0].steps[0].sql() for c in PROBED_NAMES]
    rows = nodes.select("page_id", "node_id", "end_id", "tag", F.expr(box).alias("is_box"),
        *[F.expr(f"if({p}, {literal(x)}, null)").alias(f"k{i}") for i, (p, x) in enumerate(
            zip(prices + names, ("price0", "price1", "name0", "name1")))],
        F.when(F.expr(" or ".join(prices)), F.struct(F.col("attrs")["class"].alias("class"), F.left(node_text(), F.lit(30)).alias("text"))).alias("price"),
        F.when(F.expr(" or ".join(names)), F.struct("tag", F.col("attrs")["class"].alias("class"), F.left(F.coalesce(F.col("attrs")["title"], F.lit("")), F.lit(50)).alias("title"))).alias("name"),
    )
    # The first box of a page is the smallest box id: two minima instead of a join.
    page = Window.partitionBy("page_id")
    first = F.min(F.when(F.col("is_box"), F.struct("node_id", "end_id"))).over(page)
    inside = rows.withColumn("box", first).filter(
        (F.col("node_id") > F.col("box.node_id")) & (F.col("node_id") <= F.col("box.end_id"))
    )

    # The second choice is looked at only where the first has no hit in the box.
    def chosen(a: str, b: str) -> Column:
        any_first = F.max(F.col(a).isNotNull()).over(page)
        return F.when(any_first, F.col(a).isNotNull()).otherwise(F.col(b).isNotNull())

    flagged = inside.select(
        "*",
        F.row_number().over(page.orderBy("node_id")).alias("nth"),
        chosen("k0", "k1").alias("is_price"),
        chosen("k2", "k3").alias("is_name"),
    )
    upto = page.orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = flagged.select(
        "*",
        F.sum(F.col("is_price").cast("int")).over(upto).alias("price_nth"),
        F.sum(F.col("is_name").cast("int")).over(upto).alias("name_nth"),
    )

    def listed(test, value):
        entry = F.when(test, F.struct("node_id", value.alias("v")))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"])

    return numbered.groupBy("page_id").agg(
        listed(F.col("nth") <= PROBED_TAGS, F.col("tag")).alias("tags"),
        F.count_if("is_price").alias("price_elements"),
        listed(F.col("is_price") & (F.col("price_nth") <= 3), F.col("price")).alias("prices"),
        F.count_if("is_name").alias("name_elements"),
        listed(F.col("is_name") & (F.col("name_nth") <= 2), F.col("name")).alias("names"),
    )


def content_report(texts: DataFrame, text: str = "text", key: str = "doc_id", words: tuple[str, ...] = SHOP_WORDS) -> DataFrame:
    """Length, quality band and listing words found in each text."""
    return texts.select(
        key,
        F.length(text).alias("length"),
        content_quality(F.col(text)).alias("content_quality"),
        shop_words_found(F.col(text), words).alias("indicators_found"),
    )
