"""The page reader on hand-written and generated pages."""

import collections
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.sources import parse
from pagequarry.sources.parse import TEXTS, classes, node_text, outer_html


def tree(html):
    return parse._Page(html, (), False).nodes


def tags(html):
    return [(n[parse.TAG], n[parse.DEPTH]) for n in tree(html) if n[parse.KIND] == "e"]


def test_unclosed_paragraphs_nest():
    assert tags("<div><p>a<p>b</div><i>") == [("div", 0), ("p", 1), ("p", 2), ("i", 0)]


def test_stray_end_tags_are_ignored():
    assert tags("</div><b>x</i></b></b><u></u>") == [("b", 0), ("u", 0)]


def test_void_and_self_closed_elements_hold_nothing():
    assert tags("<br>a<img><span/>b<i>c</i>") == [("br", 0), ("img", 0), ("span", 0), ("i", 0)]


def test_names_and_attributes(nodes_of):
    html = "<DIV ID=x Class=' a  b ' data-q a=1 A=2>&amp;</DIV>"
    row = nodes_of(html).select("tag", "attrs", classes().alias("c")).first()
    assert row.tag == "div"
    assert row.attrs == {"id": "x", "class": "a b", "data-q": "", "a": "2"}
    assert row.c == ["a", "b"]


def test_script_and_comment_hold_no_elements(nodes_of):
    html = '<p>a</p><script>var t="</p><b>";</script><!-- <b> --><style>b{}</style>'
    rows = nodes_of(html, elements_only=False).collect()
    assert [r.tag for r in rows if r.kind == "e"] == ["p", "script", "style"]
    assert [r.text for r in rows if r.kind == "c"] == [" <b> "]


def test_text_flavours(nodes_of):
    html = "<div> a <b>  bé </b><script>s</script><!--c-->\n d</div>"
    row = nodes_of(html, texts=TEXTS).filter("tag = 'div'").select(
        *[node_text(t).alias(t) for t in TEXTS]
    ).first()
    assert row.raw == " a   bé s\n d"
    assert row.plain == " a   bé \n d"
    assert row.stripped == "abéd"


def test_script_text_is_its_own(nodes_of):
    row = nodes_of("<div>a<script>x</script></div>").filter("tag = 'script'")
    assert row.select(node_text().alias("t")).first().t == "x"


def test_cdata_is_text_but_not_raw(nodes_of):
    row = nodes_of("<p>a<![CDATA[b]]>c</p>", texts=TEXTS).select(
        node_text("plain").alias("p"), node_text("raw").alias("r")
    ).first()
    assert (row.p, row.r) == ("abc", "ac")


def test_source_slices_and_lines(nodes_of):
    html = "<div>\n<p id=é>éé</p>\n<img src=a>\n<ul><li>x</ul></div>"
    rows = nodes_of(html, source=True).select("tag", "line", outer_html().alias("o")).collect()
    found = {r.tag: (r.line, r.o) for r in rows}
    assert found["p"] == (2, "<p id=é>éé</p>")
    assert found["img"] == (3, "<img src=a>")
    assert found["li"] == (4, "<li>x")
    assert found["div"] == (1, html)


def test_paths_index_only_among_equal_siblings(nodes_of):
    html = "<html><body><p>a</p><div><i>x</i></div><p>b</p></body></html>"
    rows = nodes_of(html, xpath=True).select("xpath").collect()
    assert [r.xpath for r in rows] == [
        "/html",
        "/html/body",
        "/html/body/p[1]",
        "/html/body/div",
        "/html/body/div/i",
        "/html/body/p[2]",
    ]


def test_empty_null_and_plain_text_pages(pages_of, nodes_of):
    assert nodes_of(None, "", "  \n").count() == 0
    assert nodes_of("just text", elements_only=False).count() == 1


def test_unreadable_page_does_not_fail_the_task(pages_of, monkeypatch):
    rows = parse.parse_pages(pages_of("<p>a</p>", "<![foo bar"), texts=()).select(
        "page_id", "parse_error", F.size("nodes").alias("n")
    )
    by_page = {r.page_id: r for r in rows.collect()}
    assert by_page[0].n == 2 and by_page[0].parse_error is None


def test_a_large_page_is_split_into_rows_and_keeps_its_texts(spark, nodes_of):
    items = "".join(f"<li>é{i}</li>" for i in range(40_000))
    rows = nodes_of(f"<ul>{items}</ul>", source=True, texts=("stripped",))
    got = rows.filter("tag = 'li'").select(
        "part", "sib_idx", node_text().alias("t"), outer_html().alias("o")
    )
    assert got.select("part").distinct().count() > 1
    wrong = got.filter(
        (F.col("t") != F.concat(F.lit("é"), F.col("sib_idx") - 1))
        | (F.col("o") != F.concat(F.lit("<li>é"), F.col("sib_idx") - 1, F.lit("</li>")))
    )
    assert got.count() == 40_000 and wrong.count() == 0


def test_five_megabytes_of_nested_paragraphs(nodes_of):
    rows = nodes_of("<p>word " * 700_000, texts=())
    row = rows.agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.max("end_id").alias("e")).first()
    assert (row.n, row.d, row.e) == (700_000, 699_999, 1_399_999)


PIECES = st.sampled_from(
    ["<div>", "</div>", "<p>", "</p>", "<br>", "<b class='x'>", "</b>", "téxt ", "<li/>", "<!--c-->",
     "<script>if (a<b) x;</script>", "&lt;", " \n", "<a href='/p/1'>", "</a>", "<ul", "<![CDATA[z]]>"]
)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=60))
def test_intervals_nest(pieces):
    page = parse._Page("".join(pieces), TEXTS, True)
    nodes = page.nodes
    for i, n in enumerate(nodes):
        parent = n[parse.PARENT]
        assert n[parse.END] >= i
        if parent == parse.ROOT:
            assert n[parse.DEPTH] == 0
        else:
            assert nodes[parent][parse.DEPTH] == n[parse.DEPTH] - 1
            assert parent < i and n[parse.END] <= nodes[parent][parse.END]
        for t, blob in enumerate(page.blobs):
            s, e = n[parse.SPANS + 2 * t : parse.SPANS + 2 * t + 2]
            assert 0 <= s <= e <= len(blob)
            bytes(blob[s:e]).decode("utf-8")
    inside = random.Random(1)
    for _ in range(20):
        if len(nodes) > 1:
            a, b = sorted(inside.sample(range(len(nodes)), 2))
            up, p = [], nodes[b][parse.PARENT]
            while p != parse.ROOT:
                up.append(p)
                p = nodes[p][parse.PARENT]
            assert (a in up) == (a < b <= nodes[a][parse.END] and nodes[a][parse.KIND] == "e")


# -- measures of a page's texts -------------------------------------------------------------------

LETTERS, WORD = re.compile("[A-Za-z0-9']*"), re.compile("[A-Za-z0-9']{2,}")
PIECES = ["<b>", "</b>", "<div>", "</div>", "<p>", "ab", "c", "d e", "  ", " x", " y ", "é", "a'b", "<br>", "</p>"]
PIECES += ["<script>q r</script>", "<div>z</div>", "<!--c-->", " ", "<![CDATA[in]]>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_measures_equal_brute_force(html):
    page = parse._Page(html, TEXTS, True)
    raw, stripped = bytes(page.blobs[TEXTS.index("raw")]), bytes(page.blobs[TEXTS.index("stripped")])
    at = parse.SPANS + 2 * TEXTS.index("raw")
    words, first, same = collections.Counter(), {}, {}
    copies = page.same_source("div")
    for i, (node, size) in enumerate(zip(page.nodes, page.sizes())):
        if node[parse.KIND] != "e":
            assert size is None
            continue
        text = raw[node[at] : node[at + 1]].decode().strip()
        assert (size[2], raw[size[0] : size[1]].decode()) == (len(text), text)
        if node[parse.STRING] is not None and node[parse.STRING].strip():
            for place, word in enumerate(WORD.findall(text)):
                words[word] += 1
                first.setdefault(word, (i, place))
        if node[parse.TAG] == "div":
            assert copies[i] == same.setdefault(page.html_bytes[node[-3] : node[-2]], i)
    got, found = collections.Counter(), {}
    for text, weight, owner, place in page.word_pieces(LETTERS):
        for nth, word in enumerate(WORD.findall(text)):
            got[word] += weight
            found[word] = min(found.get(word, (1 << 30,)), (owner, place, nth))
    assert got == words and sorted(first, key=first.get) == sorted(found, key=found.get)
    longest = page.longest_strings()
    for i, node in enumerate(page.nodes):
        below = [(-len(n[parse.STRING].strip()), j) for j, n in enumerate(page.nodes[i + 1 : node[parse.END] + 1], i + 1) if n[parse.KIND] == "t"]
        if node[parse.KIND] == "e" and below and min(below)[0]:
            s, e = longest[i]
            assert stripped[s:e].decode() == page.nodes[min(below)[1]][parse.STRING].strip()
        else:
            assert i not in longest


def test_ten_thousand_nested_elements_are_measured_in_linear_time():
    def spent(depth):
        page = parse._Page("<div>ab " * depth + "</div>" * depth, ("raw",), True)
        start = time.process_time()
        sizes, pieces, same = list(page.sizes()), page.word_pieces(LETTERS), page.same_source("div")
        assert sizes[0][2] == 3 * depth - 1 and len(same) == depth
        assert sum(weight * len(WORD.findall(text)) for text, weight, *_ in pieces) == depth * (depth + 1) // 2
        return time.process_time() - start

    spent(1000)
    assert spent(10_000) < 40 * max(spent(1000), 0.002)


def _large(n):
    items = "\n".join(f"<p>text {i} <b>bold é</b></p>" for i in range(n))
    return f"<html><body>before<script>var a</script>{items}<div>last</div>after</body></html>"


def test_rows_of_a_large_page_hold_its_text_once_and_what_reaches_beyond_once_more(pages_of):
    pages = pages_of(_large(20_000))
    split = parse.parse_pages(pages, texts=TEXTS, source=True, sizes=True, longest=True)
    whole = parse.parse_pages(pages, texts=TEXTS, source=True, sizes=True, longest=True, whole=True)
    assert (split.count(), whole.count()) == (8, 1)
    for blob in (*TEXTS, "source"):
        size = F.sum(F.octet_length(blob))
        assert split.agg(size).first()[0] <= 2 * whole.agg(size).first()[0]
    assert split.agg(F.max(F.size("nodes"))).first()[0] <= parse.NODES_PER_ROW

    def digest(parsed):
        rows = parse.node_rows(parsed)
        cells = [node_text(t) for t in (*TEXTS, "source")]
        cells += [F.substr("raw", F.col("trim_s") + 1, F.col("trim_e") - F.col("trim_s")).cast("string"), F.col("size").cast("string")]
        cells += [F.substr("stripped", F.col("long_s") + 1, F.col("long_e") - F.col("long_s")).cast("string")]
        return rows.agg(F.count("*"), *[F.sum(F.crc32(F.concat(F.col("node_id").cast("string"), F.coalesce(c, F.lit("-"))).cast("binary"))) for c in cells]).first()

    assert digest(split) == digest(whole)


def test_text_search_on_a_large_page_yields_the_parents_text(pages_of):
    from pagequarry.operators.extract import ANY_SITE, css, extract_rows

    config = {ANY_SITE: {"product_container": css("body"), "name": css(':contains("text 19999")'), "rating": css(':contains("before")')}}
    row = extract_rows(pages_of(_large(20_000)), config, ("name", "rating")).first()
    assert row.name == "text 19999bold é" and row.rating.startswith("beforetext 0") and row.rating.endswith("lastafter")


def test_a_page_of_a_million_nodes(pages_of):
    html = "<body>" + "<i>x</i>\n" * 340_000 + "</body>"
    parsed = parse.parse_pages(pages_of(html), texts=("stripped",))
    got = parsed.agg(F.sum(F.size("nodes")), F.max(F.size("nodes")), F.sum(F.octet_length("stripped"))).first()
    assert tuple(got)[:2] == (1_020_001, parse.NODES_PER_ROW) and 340_000 <= got[2] <= 2 * 340_000


def test_table_function_in_sql(spark, pages_of):
    from pagequarry.sources import table_functions

    table_functions.register(spark)
    pages = pages_of("<div ID=x>a<p>b</p><p> c</p></div>", None, " ")
    sql = "select p.page_id, n.* from {p} p, lateral page_nodes(p.html, text => 'stripped', xpath => true) n where kind = 'e' order by node_id"
    rows = spark.sql(sql, p=pages).collect()
    assert [(r.node_id, r.end_id, r.tag, r.child_count, r.text, r.content, r.xpath) for r in rows] == [
        (0, 5, "div", 2, "a", "abc", "/div"),
        (2, 3, "p", 0, "b", "b", "/div/p[1]"),
        (4, 5, "p", 0, " c", "c", "/div/p[2]"),
    ]
    assert rows[0].attrs == {"id": "x"} and rows[0].parent_id == parse.ROOT
    assert "content" not in spark.sql("select n.* from {p} p, lateral page_nodes(p.html) n", p=pages).columns
    with pytest.raises(Exception, match="text is one of"):
        spark.sql("select n.* from {p} p, lateral page_nodes(p.html, text => 'no') n", p=pages).collect()
