"""Configuration tables: conversion, checks, merging, proposals."""

from pagequarry.operators import config
from pagequarry.operators.extract import Rule, configs_from_table, css, rules_from_dict
from pagequarry.operators.heuristics import field_hints
from pagequarry.operators.sites import built_in_sites, platform_templates

PROPOSED = "site string, field string, type string, selectors array<string>"


def as_set(table):
    return {(r.site, r.field, r.type, r["rank"], r.selector) for r in table.collect()}


def test_table_round_trip(spark):
    sites = built_in_sites()
    assert configs_from_table(config.selector_table(spark, sites)) == sites


def test_create_config_leaves_out_empty_lists():
    made = config.create_selector_config(["li"], ["b"], ["i"], rating=["u", "s"], reviews=[], offers=None)
    assert made == {
        "product_container": css("li"),
        "name": css("b"),
        "current_price": css("i"),
        "rating": css("u", "s"),
    }


def test_rules_from_dict_defaults():
    rules = rules_from_dict({"product_container": {"type": "css"}, "name": {}, "rating": {"type": "XPATH", "selectors": [".//b"]}})
    assert rules == {"product_container": css("div"), "rating": (Rule(".//b", "xpath"),)}


def test_convert_sites(spark):
    old = spark.createDataFrame(
        [("a", "product_selector", ["li"]), ("a", "price_selectors", ["i", "u"]), ("a", "url", ["x"]), ("b", "name_selectors", ["b"])],
        "site string, key string, selectors array<string>",
    )
    assert as_set(config.convert_sites(old)) == {
        ("a", "product_container", "css", 0, "li"),
        ("a", "current_price", "css", 0, "i"),
        ("a", "current_price", "css", 1, "u"),
        ("b", "name", "css", 0, "b"),
        ("b", "product_container", "css", 0, "div"),
    }


def test_upsert_replaces_valid_and_rejects_the_rest(spark):
    current = config.selector_table(spark, {"a": {"name": css("b", "i"), "rating": css("u")}})
    proposals = spark.createDataFrame(
        [("a", "name", "xpath", [".//h1"]), ("a", "image_url", "css", ["x"]), ("a", "rating", "sql", ["x"]), ("a", "offers", "css", [])],
        PROPOSED,
    )
    table, rejected = config.upsert_selectors(current, proposals)
    assert as_set(table) == {("a", "name", "xpath", 0, ".//h1"), ("a", "rating", "css", 0, "u")}
    assert {r.field: r.reason for r in rejected.collect()} == {
        "image_url": "Invalid field 'image_url'",
        "rating": "Invalid selector type 'sql'",
        "offers": "Selectors must be a non-empty list of strings",
    }


def test_available_fields(spark):
    table = config.selector_table(spark, {"a": {"name": css("b", "i")}})
    rows = {r.field: (r.selectors, r.description) for r in config.available_fields(table).collect()}
    assert len(rows) == 8 and rows["name"] == (2, "Product name/title") and rows["offers"][0] == 0


def test_merge_fills_required_fields_and_retags_paths(spark):
    proposed = spark.createDataFrame(
        [("a", "name", "css", [".//h1"]), ("a", "offers", "css", ["p"]), ("b", "name", "css", ["h1"])], PROPOSED
    )
    templates = config.nested_form(config.selector_table(spark, platform_templates()))
    templates = templates.filter("not (site = 'myntra' and field = 'product_container')")
    platforms = spark.createDataFrame([("a", "amazon"), ("b", "myntra")], "site string, platform string")
    table, errors = config.merge_with_templates(proposed, templates, platforms)
    found = as_set(table)
    assert ("a", "name", "xpath", 0, ".//h1") in found and ("a", "offers", "css", 0, "p") in found
    assert ("a", "rating", "css", 0, "span.a-icon-alt") in found
    assert not any(x[0] == "a" and x[4] == "span.promo" for x in found)  # offers are not required
    assert [r.site for r in errors.collect()] == ["b"] and not any(x[0] == "b" for x in found)


def test_hints_and_json_proposals(spark):
    from pyspark.sql import functions as F

    lists = field_hints(spark).orderBy("rank").groupBy("field").agg(F.sort_array(F.collect_list(F.struct("rank", "hint"))).alias("h"))
    hints = config.from_hints(lists.select("field", F.transform("h", lambda x: x["hint"]).alias("hints")))
    by_field = {r.field: r.selectors for r in hints.collect()}
    assert by_field["image"] == [".//img[1]/@src", ".//img[1]/@data-src"]
    texts = spark.createDataFrame(
        [("a", '{"selectors": {"link": {"type": "xpath", "selectors": ["x", "x", "", "y", "z", "w"]}, "image": {"selectors": []}}}'), ("b", "no json")],
        "site string, proposal string",
    )
    per_site = hints.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("site"), "*")
    rows = {(r.site, r.field): (r.type, r.selectors) for r in config.from_json_proposals(texts, per_site).collect()}
    assert rows[("a", "link")] == ("xpath", ["x", "y", "z"])
    assert rows[("a", "image")][1] == by_field["image"] and rows[("b", "link")][1] == by_field["link"]
    assert config.adopt_proposals(config.from_json_proposals(texts, per_site)).count() == 0
