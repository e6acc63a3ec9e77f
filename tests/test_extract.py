"""Field rules: fallbacks, text search, regex fields, cleaning, container choice."""

import pytest

from pyspark.sql import functions as F

from pagequarry.operators.extract import ANY_SITE, Rule, css, extract_products, extract_rows, rules_from_dict
from pagequarry.operators.legacy import valid_names


def one(pages, config, field="name", **options):
    rows = extract_rows(pages, {ANY_SITE: config}, (field,), **options).orderBy("page_id", "index")
    return [r[field] for r in rows.collect()]


def box(**fields):
    return {"product_container": css("li"), **fields}


def test_empty_first_match_moves_on_to_the_next_selector(pages_of):
    pages = pages_of("<li><i></i><i>x</i><b>y</b></li>")
    assert one(pages, box(name=css("i", "b"))) == ["y"]


def test_text_search_ignores_the_tag_and_case(pages_of):
    pages = pages_of("<li><p>Now 20% OFF today</p></li><li><p>none</p></li>")
    assert one(pages, box(name=css('span:contains("% off")'))) == ["Now 20% OFF today", None]


def test_text_search_sees_scripts_and_comments(pages_of):
    pages = pages_of("<li><script>var off;</script></li><li>x<!-- off --></li>")
    assert one(pages, box(name=css('b:contains("off")'))) == ["var off;", "x"]


def test_regex_field_uses_the_whole_container_text(pages_of):
    pages = pages_of("<li>Price: <b>12</b>.50</li><li>no</li>")
    rule = Rule("", "regex", regex=r"price:\s*(\d+\.\d+)")
    assert one(pages, box(name=(rule,))) == ["12.50", None]


def test_pattern_key_works_like_regex():
    rules = rules_from_dict({"name": {"type": "regex", "selectors": [""], "pattern": "a"}})
    assert rules["name"] == (Rule("", "regex", None, "a"),)


def test_clean_regex_passes_other_values_through_untouched(pages_of):
    pages = pages_of("<li><b>a  7</b></li><li><b>a  b</b></li>")
    assert one(pages, box(name=(Rule("b", regex=r"(\d)"),))) == ["7", "a  b"]


def test_whitespace_is_collapsed(pages_of):
    assert one(pages_of("<li><b> a  \n b </b></li>"), box(name=css("b"))) == ["a b"]


def test_bad_regex_means_no_value(pages_of):
    assert one(pages_of("<li><b>a</b></li>"), box(name=(Rule("", "regex", regex="("),))) == [None]


def test_first_container_selector_with_a_hit_decides(pages_of):
    pages = pages_of("<li>a</li><p>b</p>", "<p>c</p>", "<div>d</div>")
    config = {"product_container": css("li", "p")}
    rows = extract_rows(pages, {ANY_SITE: config}, ())
    assert sorted((r.page_id, r["index"]) for r in rows.collect()) == [(0, 1), (1, 1)]


def test_container_defaults_to_div_only_when_unset(pages_of):
    pages = pages_of("<div>d</div>")
    assert extract_rows(pages, {ANY_SITE: {}}, ()).count() == 1
    assert extract_rows(pages, {ANY_SITE: {"product_container": ()}}, ()).count() == 0


def test_no_hit_gives_no_rows(pages_of):
    config = {"product_container": css("div.nonexistent"), "name": css("b")}
    assert extract_products(pages_of("<div><b>x</b></div>"), {ANY_SITE: config}).count() == 0


def test_css_ancestor_may_lie_outside_the_container_xpath_may_not(pages_of):
    pages = pages_of("<ul><li><b>x</b></li></ul>")
    assert one(pages, box(name=css("ul b"))) == ["x"]
    assert one(pages, box(name=(Rule(".//ul//b", "xpath"),))) == [None]


def test_nested_containers_each_see_their_own_first_match(pages_of):
    pages = pages_of("<li><b>out</b><li><b>in</b></li><i>z</i></li>")
    assert one(pages, box(name=css("b"))) == ["out", "in"]


def test_find_looks_only_into_the_first_outer_hit(pages_of):
    pages = pages_of("<li><p>no</p><p><b>x</b></p></li>")
    assert one(pages, box(name=(Rule("p >> b", "find"),))) == [None]
    assert one(pages, box(name=(Rule(".//p//b", "xpath"),))) == ["x"]


def test_validity(pages_of):
    pages = pages_of("<li><b>x</b><i>5</i></li><li><i>5</i></li><li><b>xy</b></li><li></li>")
    config = box(name=css("b"), current_price=css("i"))
    rows = extract_products(pages, {ANY_SITE: config}).orderBy("index").collect()
    assert [(r["index"], r.name, r.current_price) for r in rows] == [(2, None, "5"), (3, "xy", None)]


def test_sites_use_their_own_configuration(spark):
    pages = spark.createDataFrame(
        [(i, "<li><b>bb</b><i>ii</i></li>", s) for i, s in enumerate(["one", "two", "none"])],
        "page_id bigint, html string, site string",
    )
    configs = {"one": box(name=css("b")), "two": box(name=css("i"))}
    rows = extract_products(pages, configs).collect()
    assert {r.site: r.name for r in rows} == {"one": "bb", "two": "ii"}


def test_many_selectors_plan_quickly(pages_of):
    import time

    config = box(**{f"f{i}": css(*[f"b.c{i}_{j} i" for j in range(8)]) for i in range(16)})
    start = time.time()
    rows = extract_rows(pages_of("<li><b class=c3_1><i>x</i></b></li>"), {ANY_SITE: config}, tuple(f"f{i}" for i in range(16)))
    assert rows.filter("f3 is not null").count() == 1
    assert time.time() - start < 90


def test_one_page_may_hold_most_rows(spark):
    html = "".join(f"<li><b>n{i}</b></li>" for i in range(30_000))
    pages = spark.createDataFrame([(0, html, "s"), (1, "<li><b>m</b></li>", "s")], "page_id bigint, html string, site string")
    rows = extract_rows(pages, {ANY_SITE: box(name=css("b"))}, ("name",))
    assert rows.filter("name = concat('n', index - 1)").count() == 30_000


@pytest.mark.parametrize("site,name,ok", [("amazon", "x" * 9, False), ("amazon", "x" * 10, True), ("sathya", "₹5", False), ("other", "x", True)])
def test_name_rules(spark, site, name, ok):
    from pagequarry.operators.legacy import name_rules

    rows = spark.createDataFrame([(site, name)], "site string, name string")
    assert valid_names(rows, name_rules(spark)).count() == int(ok)


def test_one_stored_parse_serves_different_extractions(spark, pages_of):
    from pagequarry.operators.extract import Rule, css, extract_rows, parse_once
    from pagequarry.sources.storage import cut

    box = {"product_container": css("div.p")}
    one = {"s": {**box, "name": (Rule(".//b/text()", "xpath"),), "rating": (Rule("R=(\\d)", "regex"),)}}
    two = {"s": {**box, "name": css('i:contains("x")', "b"), "reviews": (Rule("left", "string"),)}, "t": {**box, "name": css("u")}}
    fields = ("name", "rating", "reviews")
    html = '<div class="p"><b> A <i>b</i></b> R=4 <u>u</u></div><div class="p"><i a="1">x y</i><p> 3 left </p></div>'
    pages = pages_of(html, "<div class='p'><u>z</u></div>").union(pages_of(html, site="t"))
    pages = pages.withColumn("page_id", F.monotonically_increasing_id())
    pages = cut(pages, "pages")
    parsed = cut(parse_once(pages, (one, fields), (two, fields)), "parsed")
    for config in (one, two):
        got = sorted(map(str, extract_rows(pages, config, fields, parsed=parsed).collect()))
        assert got and got == sorted(map(str, extract_rows(pages, config, fields).collect()))
