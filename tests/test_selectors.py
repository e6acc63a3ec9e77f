"""Selector grammar, and matching against a plain tree walk."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import search
from pagequarry.operators.extract import ANY_SITE, Rule, css, extract_rows
from pagequarry.operators.intervals import enclosing
from pagequarry.operators.selectors import (
    NEVER,
    UnsupportedSelector,
    compile_css,
    compile_selector,
    compile_xpath,
)
from pagequarry.operators.sites import built_in_sites, list_schema, other_sets, platform_templates
from pagequarry.sources import parse


@pytest.mark.parametrize("sets", [built_in_sites, platform_templates, other_sets])
def test_every_built_in_selector_compiles(sets):
    for config in sets().values():
        for rules in config.values():
            for rule in rules:
                compile_selector(rule.type, rule.selector)


def test_list_schema_compiles():
    for rules in list_schema().values():
        assert compile_css(rules[0].selector, lists=True).paths


@pytest.mark.parametrize("bad", ["a > b", "a:hover", "a ~ b", "", "a[", "+ b"])
def test_other_css_is_refused(bad):
    with pytest.raises(UnsupportedSelector):
        compile_css(bad)


@pytest.mark.parametrize("bad", ["div", ".//a/b", ".//a[last()]", ".//@x/a", "/a"])
def test_other_xpath_is_refused(bad):
    with pytest.raises(UnsupportedSelector):
        compile_xpath(bad)


def test_text_search_forms():
    assert compile_css('span:contains("% off")').pattern == "% off"
    assert compile_css("span:contains(% off)") is NEVER
    assert compile_css("span:contains(% off)", unquoted_search=True).pattern == "% off"
    assert compile_css('span:contains("(")') is NEVER


def random_page(rng, size=60):
    out = []
    for _ in range(size):
        roll = rng.random()
        if roll < 0.55:
            tag, cls = rng.choice("abpu"), rng.choice(["", " class=x", " class='x y'", " id=k"])
            out.append(f"<{tag}{cls}>")
        elif roll < 0.85:
            out.append(f"</{rng.choice('abpu')}>")
        else:
            out.append(f"t{rng.randrange(9)} ")
    return "".join(out)


def walk(html, selector):
    """Node ids matching a descendant or adjacent css path, by walking up the tree."""
    nodes = parse._Page(html, (), False).nodes

    def ok(i, test):
        n = nodes[i]
        if n[parse.KIND] != "e" or (test.tag and n[parse.TAG] != test.tag):
            return False
        attrs = parse._attributes(n[parse.ATTRS])
        return all(t in attrs.get("class", "").split() for t in test.tokens) and all(
            name in attrs for _, name, _ in test.attrs
        )

    def before(i):
        same = [j for j, n in enumerate(nodes) if n[parse.KIND] == "e" and n[parse.PARENT] == nodes[i][parse.PARENT]]
        at = same.index(i)
        return same[at - 1] if at else None

    def matches(i, steps, joins):
        if not ok(i, steps[-1]):
            return False
        if len(steps) == 1:
            return True
        if joins[-1] == "+":
            j = before(i)
            return j is not None and matches(j, steps[:-1], joins[:-1])
        p = nodes[i][parse.PARENT]
        while p != parse.ROOT:
            if matches(p, steps[:-1], joins[:-1]):
                return True
            p = nodes[p][parse.PARENT]
        return False

    paths = compile_css(selector).paths
    return [i for i in range(len(nodes)) if any(matches(i, p.steps, p.joins) for p in paths)]


@pytest.mark.parametrize("selector", ["a b", "a b.x p", "b+u", "a p+b[id]", "p.x.y, u [id]", "a a"])
def test_css_matches_a_tree_walk(pages_of, nodes_of, selector):
    rng = random.Random(7)
    htmls = [random_page(rng) for _ in range(25)]
    hits = search._matches(nodes_of(*htmls), compile_css(selector), {"tag2": F.col("tag")}).collect()
    got = sorted((r.page_id, r.node_id) for r in hits)
    assert got == sorted((p, i) for p, h in enumerate(htmls) for i in walk(h, selector))


def test_enclosing_matches_brute_force(nodes_of):
    rng = random.Random(3)
    htmls = [random_page(rng) for _ in range(25)]
    rows = nodes_of(*htmls, elements_only=False).select(
        "page_id",
        "node_id",
        "end_id",
        F.expr("kind = 'e' and tag in ('a', 'b')").alias("box"),
        F.expr("kind = 't' or tag = 'a'").alias("event"),
        F.col("depth").alias("d"),
    ).cache()
    got = sorted((r.page_id, r.box_id, r.node_id) for r in enclosing(rows, "box", "event", ["d"]).collect())
    all_rows = rows.collect()
    want = sorted(
        (a.page_id, a.node_id, e.node_id)
        for a in all_rows
        for e in all_rows
        if a.box and e.event and a.page_id == e.page_id and a.node_id < e.node_id <= a.end_id
    )
    assert got == want


def first_in(html, box_tag, steps):
    """Per box: the first node inside it that a chain of steps inside the box leads to."""
    nodes = parse._Page(html, (), False).nodes
    out = {}
    for c, n in enumerate(nodes):
        if n[parse.KIND] != "e" or n[parse.TAG] != box_tag:
            continue
        for i in range(c + 1, n[parse.END] + 1):
            chain, p = [], i
            while p > c:
                chain.append(p)
                p = nodes[p][parse.PARENT]
            want = list(steps)
            if nodes[i][parse.KIND] == "e" and nodes[i][parse.TAG] == want[-1]:
                want.pop()
                for j in chain[1:]:
                    if want and nodes[j][parse.TAG] == want[-1]:
                        want.pop()
                if not want:
                    out[c] = i
                    break
    return out


@pytest.mark.parametrize("steps", [("b",), ("b", "u"), ("u", "b", "p")])
def test_xpath_chains_stay_inside_nested_boxes(pages_of, steps):
    rng = random.Random(11)
    htmls = [random_page(rng) for _ in range(25)]
    config = {ANY_SITE: {"product_container": css("a"), "hit": (Rule(".//" + "//".join(steps), "xpath"),)}}
    rows = extract_rows(pages_of(*htmls), config, ("hit",), cleaning="raw").collect()
    got = {(r.page_id, r.box_id): r.hit is not None for r in rows}
    for p, html in enumerate(htmls):
        firsts = first_in(html, "a", steps)
        boxes = [i for i, n in enumerate(parse._Page(html, (), False).nodes) if n[parse.KIND] == "e" and n[parse.TAG] == "a"]
        assert {b: got[(p, b)] for b in boxes} == {b: b in firsts for b in boxes}
