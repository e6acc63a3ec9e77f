"""Physical plans: what is shuffled, joined and read."""

import re

import pytest

from pagequarry.operators import quality, summary
from pagequarry.operators.extract import extract_products
from pagequarry.queries.listing import SELECTORS
from pagequarry.sources.parse import node_rows, parse_pages

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    return spark.read.parquet(f"{SF}/pages.parquet").withColumn("site", F.lit("s"))


def test_extraction_shuffles_once_and_joins_nothing(pages):
    text = plan(extract_products(pages, SELECTORS))
    assert text.count("Exchange hashpartitioning") == 1
    assert "Join" not in text and text.count("MapInArrow") == 1


def test_page_texts_are_not_shuffled(pages):
    text = plan(extract_products(pages, SELECTORS))
    exchange = next(line for line in text.splitlines() if "Exchange hashpartitioning" in line)
    below = text[text.index(exchange) :].splitlines()[1]
    assert "Project" in below and "stripped#" not in below.split("substr")[0].replace("css_text", "")


def test_counts_are_combined_before_the_shuffle(pages):
    text = plan(quality.field_performance(extract_products(pages, SELECTORS)))
    assert "partial_count" in text


def test_top_lists_are_pruned_before_ranking(pages):
    nodes = node_rows(parse_pages(pages, texts=()))
    text = plan(summary.top_values(nodes, "href", by=("site",)))
    assert "WindowGroupLimit" in text


def test_page_meta_reads_two_columns(spark):
    text = plan(summary.page_meta(spark.read.parquet(f"{SF}/pages.parquet")))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text and "MapInArrow" not in text


def test_no_quadratic_joins(spark):
    import __spark_entry__ as entry

    runs = entry.queries()
    for name in ("forms", "heuristic_fields", "cards", "listing_products", "quality_gate", "top_hrefs"):
        text = plan(runs[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_stream_marks_do_not_depend_on_batches(spark, tmp_path):
    from pagequarry.queries.listing import listing_pages
    from pagequarry.streaming import continuous

    pages = listing_pages(spark, SF).selectExpr("page_id", "url", "html", "site", "timestamp '2024-01-01' as scraped_at")
    pages.repartition(4).write.parquet(str(tmp_path / "in"))
    marks = []
    for files in (1, 1000):
        out, state = str(tmp_path / f"out{files}"), str(tmp_path / f"state{files}")
        landed = continuous.landed_pages(spark, str(tmp_path / "in"), files)
        continuous.extract_stream(landed, SELECTORS, out, state).awaitTermination()
        rows = continuous.gated_products(spark, out, 57.5).select("page_id", "index", "overall_success_rate", "below_threshold")
        marks.append(sorted((r.page_id, r["index"], round(r.overall_success_rate, 6), r.below_threshold) for r in rows.collect()))
    assert marks[0] == marks[1] and {m[3] for m in marks[0]} == {True, False}


def test_sample_of_rows_keyed_by_text(spark):
    from pagequarry.operators import quality

    rows = spark.createDataFrame([(f"/p/{i // 3:03}", i % 3) for i in range(90)], 'page_id string, "index" int'.replace('"', "`"))
    got = quality.systematic_sample(rows, 10, ("page_id", "index")).collect()
    assert sorted((r.page_id, r["index"]) for r in got) == [(f"/p/{p // 3:03}", p % 3) for p in range(0, 90, 9)]


def test_pages_are_parsed_once(spark):
    import __spark_entry__ as entry

    runs = entry.queries()
    for name in ("forms", "form_flags", "confidence"):
        text = plan(runs[name](spark, SF))
        assert text.count("MapInArrow") == 1 and "Join" not in text, name
    for name in ("validate_prices", "validation_summary", "improvement_suggestions", "quality_gate", "run_report"):
        assert "MapInArrow" not in plan(runs[name](spark, SF)), name  # they read the stored products


def test_unread_pages_are_reported_with_the_whole_error(spark):
    from pagequarry.sources.pages import unread_pages

    parsed = spark.createDataFrame([(1, None), (2, "AssertionError: " + "x" * 400)], "page_id long, parse_error string")
    assert [(r.page_id, len(r.reason)) for r in unread_pages(parsed).collect()] == [(2, 416)]


@pytest.mark.parametrize(
    "name", ["cards", "site_products", "heuristic_fields", "sample_extractions", "signature_samples", "clustered_subtrees", "selector_probe", "card_counts"]
)
def test_one_parse_and_no_page_in_a_join(spark, name):
    import __spark_entry__ as entry

    text = plan(entry.queries()[name](spark, SF))
    joins = text.count("Join")
    assert text.count("MapInArrow") == 1
    # Only the table of name rules, a row for each site, is joined.
    assert joins <= (2 if name == "site_products" else 0)


@pytest.mark.parametrize("name", ["text_stats", "repeated_signatures", "suggested_container", "signature_samples", "longest_elements", "page_text_patterns"])
def test_reports_on_a_page_shuffle_nothing(spark, name):
    import __spark_entry__ as entry

    text = plan(entry.queries()[name](spark, SF))
    assert "Exchange hashpartitioning" not in text and text.count("MapInArrow") == 1


def test_cards_of_pages_without_a_container(spark, pages_of):
    from pagequarry.operators.cards import cards, looks_like_card

    html = '<div class="a"><div class="DMMoT0"><img src="x/rukminim2.flixcart.com/1" alt="Pan"></div><p>q</p></div><div><b>n</b></div>'
    pages = pages_of(html, "<div>none</div>").select("page_id", "html")
    assert [tuple(r) for r in looks_like_card(pages).collect()] == [(0, 1, 1)]
    assert [(r.page_id, r.product_id, r.title) for r in cards(pages).collect()] == [(0, "product_1", "Pan")]


@pytest.mark.parametrize("name", ["improved_run", "repeated_append"])
def test_repeated_extractions_parse_the_pages_once(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from pagequarry.operators import extract

    calls, parse = [], extract.parse_pages
    monkeypatch.setattr(extract, "parse_pages", lambda *a, **b: calls.append(1) or parse(*a, **b))
    assert entry.queries()[name](spark, SF).count() > 0
    assert len(calls) == 1


def test_a_task_of_site_products_does_not_grow_with_parts_or_sites(spark, monkeypatch):
    """No shuffle by site, whatever Spark would broadcast by itself, and more tasks for more parts, with the same rows."""
    import __spark_entry__ as entry
    from pagequarry.queries import market

    run = entry.queries()["site_products"]
    few = sorted(map(str, run(spark, SF).collect()))
    monkeypatch.setattr(market, "PARTS_PER_TASK", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = run(spark, SF)
        text = plan(rows)
        assert "hashpartitioning(site" not in text
        assert f", {market.market_partitions(spark, SF)}), REPARTITION_BY_NUM" in text
        assert sorted(map(str, rows.collect())) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_page_lists_are_counted_without_a_sort(pages):
    parsed = summary.text_pages(pages)
    nodes = node_rows(parse_pages(pages, texts=()))
    for counts in (summary.piece_words(parsed), summary.frequencies(nodes, ("tag", "class")), summary.attribute_counts(nodes), summary.attribute_values(nodes)):
        text = plan(counts)
        assert "HashAggregate" in text and "SortAggregate" not in text


def test_first_places_of_words_break_ties(spark):
    """Equal counts: by the first text element, then the string, then the word's place in it."""
    pieces = [("zz yy", 1, 7, 3), ("xx ww", 1, 2, 9), ("vv uu", 1, 2, 2**31 - 1)]
    rows = spark.createDataFrame([(1, pieces)], "page_id long, pieces array<struct<text:string,weight:int,owner:int,place:int>>")
    got = summary.piece_words(rows).orderBy("first").collect()
    assert [r.word for r in got] == ["xx", "ww", "vv", "uu", "zz", "yy"]


def test_summaries_look_for_repeated_subtrees_once(spark, pages, monkeypatch):
    from pagequarry.operators import heuristics
    from pagequarry.plans import summarize

    looked = []

    def counted(parsed, whole=summary.with_repeats):
        looked.append("repeats" not in parsed.columns)
        return whole(parsed)

    monkeypatch.setattr(summary, "with_repeats", counted)
    monkeypatch.setattr(heuristics, "with_repeats", counted)
    assert summarize.summarize(pages.limit(3)).count() == 3 and sum(looked) == 1


def test_summaries_shuffle_pages_and_not_their_words_or_values(pages):
    """Every shuffle is by page, so that none of the counts, ranks and joins needs another."""
    from pagequarry.plans import summarize

    text = plan(summarize.summarize(pages))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert keys and all(re.fullmatch(r"page_id#\d+L, \d+", k) for k in keys)


def test_summaries_store_the_parsed_pages_only_once_and_pack_the_report(spark, tmp_path, monkeypatch):
    """Nothing of the stored pages is stored again, and the report is text in packed files."""
    import __spark_entry__ as entry
    from pagequarry.sources import storage

    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    rows = entry.queries()["page_summary_json"](spark, SF)
    folders = {p.name.rpartition("-")[0]: [f.name for f in p.glob("part-*")] for p in tmp_path.iterdir()}
    assert sorted(folders) == ["parsed", "summaries"] and rows.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(f.endswith(".txt.gz") for f in folders["summaries"])


def test_attribute_statistics_of_a_page(spark, pages_of):
    """Most frequent attributes of a tag with their values; empty values count for the attribute only."""
    from pagequarry.plans import summarize

    html = '<a href="x" b>1</a><a b="">2</a><a href="y" b="">3</a><a href="y">4</a><p id="i">5</p>'
    rows = summarize.summarize(pages_of(html, "<p>plain</p>", "<i off>6</i>"), keys=("attribute_stats",)).collect()
    stats = {r.page_id: r.attribute_stats and [(a.tag, a.attribute, a["count"], a.top_values and [tuple(v) for v in a.top_values]) for a in r.attribute_stats] for r in rows}
    assert stats == {
        0: [("a", "href", 3, [("y", 2), ("x", 1)]), ("a", "b", 3, None), ("p", "id", 1, [("i", 1)])],
        1: None,
        2: [("i", "off", 1, None)],
    }


def test_only_texts_with_an_at_sign_are_searched_for_addresses(spark):
    from pagequarry.functions.patterns import pattern_examples
    from pyspark.sql import functions as F

    texts = ["write to a.b@c.org, x@y.zz or @home", "at c.org", "@", "", None]
    found = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", pattern_examples(F.col("t"), "emails").alias("e"))
    assert [r.e for r in found.orderBy("id").collect()] == [["a.b@c.org", "x@y.zz"], [], [], [], None]
    assert "Contains(t" in plan(found) or "contains(t" in plan(found).lower()


def test_stored_pages_come_back_with_their_texts(pages_of):
    """The texts share a cell, cut by bytes: also where they are empty or have characters of several bytes."""
    from pagequarry.plans import summarize

    pages = pages_of("<p>é  ü</p> <b>日本</b>", "<br>", "<!-- c -->", "plain", "<p> x </p>")
    parsed = summary.text_pages(pages, texts=("raw", "stripped"), source=True)
    stored = summarize._stored(parsed)
    names = [f.name for f in parsed.schema.fields]
    assert sorted(stored.columns) == sorted(names) and stored.select(*names).dtypes == parsed.dtypes
    rows = lambda d: {r.page_id: (bytes(r.source), bytes(r.raw), bytes(r.stripped), str(r.nodes), str(r.pieces)) for r in d.collect()}
    assert rows(stored) == rows(parsed) and len(rows(parsed)) == 5
