"""Selector-driven extraction: pages and selector configurations to one row per container.

Plan: parse, keep only rows that some selector or container could use, one shuffle on page_id, then
windows over document order (see structure.py). Texts and attributes are cut out before the shuffle,
so neither pages nor page texts travel. The number of windows follows the number of selectors, not
the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import clean_text, regex_clean, regex_value, strip
from pagequarry.operators import structure
from pagequarry.operators.intervals import enclosing
from pagequarry.operators.selectors import (
    HOLDS,
    Path,
    Picked,
    Selector,
    Test,
    compile_css,
    compile_selector,
    compile_xpath,
    literal,
)
from pagequarry.schema import FIELDS, MISSING
from pagequarry.sources.parse import node_rows, node_text, parse_pages

ANY_SITE = "*"
# Flags travel as bits of long columns: one filter term per column keeps planning time flat too.
MASK_BITS = 62


@dataclass(frozen=True)
class Rule:
    """One selector of a field with an optional attribute and value regex. Types: css, xpath, regex,
    and for the built-in extractors find (see compile_find) and string (the searched string itself)."""

    selector: str
    type: str = "css"
    attribute: str | None = None
    regex: str | None = None


# Field to its rules in fallback order.
Config = Mapping[str, tuple[Rule, ...]]


def css(*selectors: str) -> tuple[Rule, ...]:
    return tuple(Rule(s) for s in selectors)


def rules_from_dict(config: Mapping[str, Mapping]) -> dict[str, tuple[Rule, ...]]:
    """Nested form {field: {type, selectors, attribute?, regex? (or pattern)}} to rules."""
    return {
        name: tuple(
            Rule(
                text,
                (cfg.get("type") or cfg.get("selector_type") or "css").lower(),
                cfg.get("attribute"),
                cfg.get("regex") or cfg.get("pattern"),
            )
            for text in cfg.get("selectors", ("div",) if name == "product_container" else ())
        )
        for name, cfg in config.items()
        if cfg
    }


def configs_from_table(selectors: DataFrame) -> dict[str, dict[str, tuple[Rule, ...]]]:
    """Selector table (SELECTORS_SCHEMA) to one configuration per site. Selectors are code: the driver
    reads them, a partition at a time, to compile them into the plan."""
    configs: dict[str, dict[str, tuple[Rule, ...]]] = {}
    for row in selectors.orderBy("site", "field", "rank").toLocalIterator():
        fields = configs.setdefault(row.site, {})
        rule = Rule(row.selector, row.type or "css", row.attribute, row.regex)
        fields[row.field] = (*fields.get(row.field, ()), rule)
    return configs


# -- matching -------------------------------------------------------------------------------------


@dataclass
class _Need:
    """One selector of one configuration with what its match yields."""

    config: int
    field: str
    rank: int
    selector: Selector
    attribute: str | None
    regex: str | None = None


class _Plan:
    """Compiles configurations and builds the window plan over parsed pages."""

    def __init__(
        self,
        configs: Mapping[str, Config],
        fields: tuple[str, ...],
        lists: bool = False,
        cleaning: str = "clean",
        picked: str | None = None,
        box_values: Mapping[str, Column] | None = None,
        texts: tuple[str, ...] = (),
        prepare: Callable[[DataFrame], DataFrame] | None = None,
        parse: Mapping[str, object] | None = None,
        otherwise: tuple[Path, ...] = (),
        listed: str | None = None,
        parsed: DataFrame | None = None,
        partitions: int | None = None,
    ):
        self.listed, self.parsed, self.partitions = listed, parsed, partitions
        self.prepare, self.parse = prepare, dict(parse or {})
        self.fields, self.cleaning, self.picked = fields, cleaning, picked
        self.box_values, self.texts = dict(box_values or {}), texts
        self.sites: dict[str, int] = {}
        self.configs: list[Config] = []
        for site, config in configs.items():
            if config not in self.configs:
                self.configs.append(config)
            self.sites[site] = self.configs.index(config)
        self.needs: list[_Need] = []
        self.containers: list[_Need] = []
        for c, config in enumerate(self.configs):
            boxes = () if picked else config.get("product_container", css("div"))
            if picked:
                path = Path((Picked(column=picked),))
                self.containers.append(_Need(c, "product_container", 0, Selector("css", (path,)), None))
                if otherwise:
                    self.containers.append(_Need(c, "product_container", 1, Selector("css", otherwise), None))
            for rank, rule in enumerate(boxes):
                text = rule.selector
                chosen = compile_xpath(text) if rule.type == "xpath" else compile_css(text, lists=True)
                self.containers.append(_Need(c, "product_container", rank, chosen, None))
            for name in fields:
                for rank, rule in enumerate(config.get(name, ())):
                    options = {} if rule.type in ("xpath", "regex", "find", "string") else {"lists": lists}
                    chosen = compile_selector(rule.type, rule.selector, rule.regex, **options)
                    attribute = rule.attribute.lower() if rule.attribute else None
                    self.needs.append(_Need(c, name, rank, chosen, attribute, rule.regex))
        # Every step test and string search is one bit of a row's mask.
        self.bits: dict[Test | str, int] = {}
        for need in self.containers + self.needs:
            for path in need.selector.paths:
                for test in path.steps:
                    self.bits.setdefault(test, len(self.bits))
            if need.selector.kind == "search":
                self.bits.setdefault(need.selector.pattern, len(self.bits))

    # What the parse has to produce.
    def parse_options(self) -> dict:
        texts = {"stripped", *self.texts}
        for need in self.needs:
            if need.selector.kind == "xpath" and need.selector.take == "text" and not need.attribute:
                texts.add("raw")
            if need.selector.kind == "regex":
                texts.add("plain")
        return {
            "texts": tuple(texts),
            "parent_attrs": any(n.selector.kind == "search" and n.attribute for n in self.needs),
            "parent_text": any(n.selector.kind == "search" and not n.attribute for n in self.needs),
        }

    def site_config(self) -> Column:
        """Configuration number of a page's site; NULL where none applies."""
        if set(self.sites) == {ANY_SITE}:
            return F.lit(0)
        out = F.lit(self.sites.get(ANY_SITE))
        for number in range(len(self.configs)):
            names = [s for s, n in self.sites.items() if n == number and s != ANY_SITE]
            if names:
                out = F.when(F.col("site").isin(names), F.lit(number)).otherwise(out)
        return out.cast("int")

    # Flags and events are built as SQL text: a plan of many selectors is a few long expressions,
    # not thousands of column objects.

    def _for_config(self, need: _Need, test: str) -> str:
        return test if len(self.configs) == 1 else f"(cfg = {need.config} and {test})"

    def bits_sql(self, tests: Iterable[Test | str]) -> str:
        """Does a row pass any of these tests or searches?"""
        wanted: dict[int, int] = {}
        for test in tests:
            i = self.bits[test]
            wanted[i // MASK_BITS] = wanted.get(i // MASK_BITS, 0) | 1 << (i % MASK_BITS)
        terms = [f"(mask{m} & {bits}L) <> 0" for m, bits in wanted.items()]
        return f"({' or '.join(terms) or 'false'})"

    def any_bit(self, tests: Iterable[Test | str]) -> Column:
        return F.expr(self.bits_sql(tests))

    def _bits_of(self, config: int) -> set[int]:
        found = set()
        for need in self.containers + self.needs:
            if need.config == config:
                found |= {self.bits[test] for path in need.selector.paths for test in path.steps}
                if need.selector.kind == "search":
                    found.add(self.bits[need.selector.pattern])
        return found

    # Row-local work: tests, texts and attributes, before the shuffle.
    def candidates(self, nodes: DataFrame, carry: list[str]) -> DataFrame:
        wanted = {n.attribute for n in self.needs if n.attribute}
        wanted |= {n.selector.take[1:].lower() for n in self.needs if n.selector.take[0] == "@"}
        looked_at = wanted.union(*[t.names() for t in self.bits if isinstance(t, Test)])
        # Each attribute is looked up once per node, each test runs once per node: the mask comes out
        # of a generator that drops nodes without a bit, so neither is repeated in a filter.
        cells = {name: f"x{i}" for i, name in enumerate(sorted(looked_at))}
        hits = [
            t.sql(cells)
            if isinstance(t, Test)
            else f"coalesce(kind <> 'e' and rlike(text, {literal('(?i)' + t)}), false)"
            for t in self.bits
        ]
        any_string = any(n.selector.take == "strings" for n in self.needs)
        if any_string:
            hits.append("kind = 't'")
        used = [self._bits_of(c) | ({len(self.bits)} if any_string else set()) for c in range(len(self.configs))]
        masks = []
        for lo in range(0, max(len(hits), 1), MASK_BITS):
            # A page's nodes are tested for its own configuration only.
            per_config = []
            for c, bits in enumerate(used):
                some = [i for i in sorted(bits) if lo <= i < lo + MASK_BITS]
                terms = [f"if({hits[i]}, {1 << (i - lo)}L, 0L)" for i in some] or ["0L"]
                per_config.append(" | ".join(terms))
            whens = " ".join(f"when {c} then {mask}" for c, mask in enumerate(per_config))
            masks.append(per_config[0] if len(used) == 1 else f"case cfg {whens} else 0L end")
        mask_names = [f"mask{i}" for i in range(len(masks))]
        found = ", ".join(f"'{name}', {mask}" for name, mask in zip(mask_names, masks))
        none = ", ".join(f"'{name}', 0L" for name in mask_names)
        flagged = nodes.select(
            "*", *[F.expr(f"attrs[{literal(name)}]").alias(x) for name, x in cells.items()]
        ).select("*", F.expr(f"inline(array_remove(array(named_struct({found})), named_struct({none})))"))

        def flag_any(needs):
            return self.any_bit(
                [p.steps[-1] for n in needs for p in n.selector.paths]
                + [n.selector.pattern for n in needs if n.selector.kind == "search"]
            )

        css_text = [
            n
            for n in self.needs
            if n.selector.kind in ("css", "search", "find") and n.selector.take == "text" and not n.attribute
        ]
        raw_text = [
            n for n in self.needs if n.selector.kind == "xpath" and n.selector.take == "text" and not n.attribute
        ]
        strings_of = [n for n in self.needs if n.selector.take in ("string", "strings")]
        self.attr_column = {name: f"a{i}" for i, name in enumerate(sorted(wanted))}
        box = flag_any(self.containers)
        columns = [F.col(c) for c in ("page_id", "cfg", "node_id", "end_id", "parent_id", "sib_idx", "kind")]
        # Page columns matter on container rows only; elsewhere they would just widen the shuffle.
        columns += [F.when(box, F.col(c)).alias(c) for c in carry]
        columns += [F.col(name) for name in mask_names]
        empty = F.lit(None).cast("string")
        columns.append(
            (F.when(flag_any(css_text), node_text("stripped")) if css_text else empty).alias("css_text")
        )
        columns.append((F.when(flag_any(raw_text), strip(node_text("raw"))) if raw_text else empty).alias("raw_text"))
        string_here = flag_any([n for n in strings_of if n.selector.take == "string"])
        if any_string:
            string_here = string_here | (F.col("kind") == "t")
        columns.append((F.when(string_here, strip(F.col("text"))) if strings_of else empty).alias("string"))
        columns.append(F.col("text_id"))
        columns += [strip(F.col(cells[name])).alias(alias) for name, alias in self.attr_column.items()]
        regexes = sorted({n.selector.pattern for n in self.needs if n.selector.kind == "regex"})
        self.regex_column = {p: f"r{i}" for i, p in enumerate(regexes)}
        columns += [
            F.when(box, regex_value(node_text("plain"), p)).alias(alias)
            for p, alias in self.regex_column.items()
        ]
        columns += [F.when(box, value).alias(name) for name, value in self.box_values.items()]
        return flagged.select(*columns)

    # Whole-page flags: does the complete css path (or container xpath) match here?
    def whole_page_flags(self, rows: DataFrame) -> DataFrame:
        wanted = self.containers + [n for n in self.needs if n.selector.kind == "css"]
        pending: list[Path] = list(dict.fromkeys(p for n in wanted for p in n.selector.paths))
        state = {path: (self.bits_sql([path.steps[0]]), 0) for path in pending}
        level = 0
        while any(state[p][1] < len(p.steps) - 1 for p in pending):
            memo: dict[tuple, str] = {}
            new = []
            for path in pending:
                flag, at = state[path]
                if at == len(path.steps) - 1:
                    continue
                key = (flag, path.joins[at], path.steps[at + 1])
                if key not in memo:
                    memo[key] = f"p{level}_{len(memo)}"
                    related = {"+": structure.follows, HOLDS: structure.holds}.get(path.joins[at], structure.inside)
                    hit = self.any_bit([path.steps[at + 1]]) & related(F.expr(flag))
                    new.append(hit.alias(memo[key]))
                state[path] = (memo[key], at + 1)
            rows = rows.select("*", *new)
            level += 1
        self.path_flag = {path: state[path][0] for path in pending}
        return rows

    def _hit(self, need: _Need) -> str:
        flags = " or ".join(self.path_flag[p] for p in need.selector.paths)
        return self._for_config(need, f"({flags})")

    def marked_rows(self, pages: DataFrame, carry: list[str]) -> DataFrame:
        """Candidate rows of all pages with their containers marked."""
        if self.parsed is None:
            with_config = pages.withColumn("cfg", self.site_config()).filter(F.col("cfg").isNotNull())
            parsed = parse_pages(with_config, **{**self.parse_options(), **self.parse})
        else:
            parsed = self.parsed.withColumn("cfg", self.site_config()).filter(F.col("cfg").isNotNull())
        nodes = node_rows(self.prepare(parsed) if self.prepare else parsed, elements_only=False)
        rows = self.candidates(nodes, carry)
        if self.partitions:
            rows = rows.repartition(self.partitions, "page_id")
        return self.mark_containers(self.whole_page_flags(rows))

    # Containers: the first selector with a hit on the page decides.
    def mark_containers(self, rows: DataFrame) -> DataFrame:
        ranks = sorted({n.rank for n in self.containers})
        at_rank = {
            r: " or ".join(self._hit(n) for n in self.containers if n.rank == r) for r in ranks
        }
        whens = " ".join(f"when {hit} then {r}" for r, hit in at_rank.items()) or "when false then 0"
        rows = rows.withColumn("box_rank", F.expr(f"case {whens} end")).withColumn(
            "page_rank", structure.page_min(F.col("box_rank"))
        )
        chosen = " or ".join(f"(page_rank = {r} and ({hit}))" for r, hit in at_rank.items())
        rows = rows.withColumn("is_box", F.expr(f"coalesce({chosen or 'false'}, false)"))
        return rows.withColumn("index", structure.running_count(F.col("is_box")))

    def _value(self, need: _Need) -> str:
        """Column that holds what a match of this selector yields."""
        take = need.selector.take
        if take[0] == "@":
            return self.attr_column[take[1:].lower()]
        if take in ("string", "strings"):
            return "string"
        if need.attribute:
            return self.attr_column[need.attribute]
        return "raw_text" if need.selector.kind == "xpath" else "css_text"

    def events(self, rows: DataFrame) -> tuple[DataFrame, list[tuple[str, int, str, bool]]]:
        """Per (field, rank) one event column holding struct(n, value) on the rows that match."""
        slots: dict[tuple, list[str]] = {}
        chains: list[tuple[_Need, str, tuple[Test, ...]]] = []
        for need in self.needs:
            chosen = need.selector
            if chosen.kind in ("never", "regex") or need.field == self.listed:
                continue
            if chosen.kind == "search":
                hit = self._for_config(need, self.bits_sql([chosen.pattern]))
            elif chosen.kind == "css":
                hit = self._hit(need)
            elif chosen.take == "strings":
                hit = self._for_config(need, "kind = 't'")
            else:
                hit = self._for_config(need, self.bits_sql([chosen.paths[0].steps[-1]]))
            n = "node_id"
            if chosen.take == "string":
                n, hit = "text_id", f"{hit} and text_id is not null"
            event = f"if({hit}, named_struct('n', {n}, 'v', {self._value(need)}), null)"
            steps = chosen.paths[0].steps if chosen.kind in ("xpath", "find") else ()
            outer = steps if chosen.take == "strings" else steps[:-1]
            if outer:
                chains.append((need, event, outer))
            else:
                slots.setdefault((need.field, need.rank, chosen.from_root), []).append(event)
        # Chains, innermost step first. In XPath an outer step passes on the first event below it; in
        # a find it becomes the event itself, with or without a value found below it.
        rows = rows.select("*", *[F.expr(e).alias(f"c{i}") for i, (_, e, _) in enumerate(chains)])
        for depth in range(max((len(outer) for _, _, outer in chains), default=0)):
            level = [(i, n, o[-1 - depth]) for i, (n, _, o) in enumerate(chains) if depth < len(o)]
            rows = rows.withColumns({f"c{i}": structure.first_below(f"c{i}") for i, _, _ in level})
            linked = {}
            for i, need, step in level:
                here = self._for_config(need, self.bits_sql([step]))
                below = f"if(c{i}.n <= end_id, c{i}, null)"
                if need.selector.kind == "find":
                    below = f"named_struct('n', node_id, 'v', if(c{i}.n <= end_id, c{i}.v, null))"
                linked[f"c{i}"] = F.expr(f"if({here}, {below}, null)")
            rows = rows.withColumns(linked)
        for i, (need, _, _) in enumerate(chains):
            slot = (need.field, need.rank, need.selector.from_root)
            slots.setdefault(slot, []).append(f"c{i}")
        names = []
        new = []
        for i, ((name, rank, with_self), events) in enumerate(slots.items()):
            new.append(F.expr(f"coalesce({', '.join(events)})").alias(f"e{i}"))
            names.append((name, rank, f"e{i}", with_self))
        return rows.select("*", *new), names

    def list_events(self) -> Column:
        """What a row adds to the listed field: array of struct(rank, v), one for each selector that it matches."""
        found = []
        for need in self.needs:
            if need.field != self.listed or need.selector.kind not in ("search", "css"):
                continue
            searched = need.selector.kind == "search"
            hit = self._for_config(need, self.bits_sql([need.selector.pattern])) if searched else self._hit(need)
            value = self._value(need)
            found.append(f"if({hit} and {value} <> '', named_struct('rank', {need.rank}, 'v', {value}), null)")
        if not found:
            raise ValueError(f"no list selectors for {self.listed}")
        return F.expr(f"array_compact(array({', '.join(found)}))")

    def finish(self, need: _Need, value: Column) -> Column:
        """A value after its regex clean or its whitespace clean."""
        if need.regex and need.selector.kind != "regex":
            return regex_clean(value, need.regex)
        return clean_text(value) if self.cleaning == "clean" else value


def _carry(pages: DataFrame, picked: str | None = None) -> list[str]:
    return [c for c in pages.columns if c not in ("page_id", "html", picked)]


def extract_rows(
    pages: DataFrame,
    configs: Mapping[str, Config] | DataFrame,
    fields: tuple[str, ...] = FIELDS,
    lists: bool = False,
    cleaning: str = "clean",
    picked: str | None = None,
    box_values: Mapping[str, Column] | None = None,
    texts: tuple[str, ...] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    parse: Mapping[str, object] | None = None,
    otherwise: tuple[Path, ...] = (),
    listed: str | None = None,
    parsed: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per container: page columns, `index`, `box_id` (its node id) and the fields.

    `pages` needs page_id (unique per page), html and, unless the one configuration is for
    ANY_SITE, site. Pages of a site without configuration are left out before the parse.
    `cleaning`: clean (whitespace collapsed), strip (as found), raw (as found, empty kept).
    `picked` names an array column of container node ids that replaces container selectors.
    `box_values` are expressions over a container's node row, which may slice the extra `texts`.
    `prepare` may add columns to the parsed pages, such as `picked`; `parse` are further options of the parse.
    `otherwise` are paths of the containers of pages on which nothing is picked.
    `listed` names a field that yields all its values, see `extract_lists`, out of the same windows.
    `parsed` is a stored result of `parse_pages` on these pages, with what the plan needs (see `parse_once`); else they are parsed here.
    `partitions`: into how many tasks the rows are dealt by page; else as many as the session shuffles into.
    """
    if isinstance(configs, DataFrame):
        configs = configs_from_table(configs)
    if listed:
        fields = tuple(f for f in fields if f != listed)
    plan = _Plan(configs, (*fields, *([listed] if listed else [])), lists, cleaning, picked, box_values, texts, prepare, parse, otherwise, listed, parsed, partitions)
    carry = _carry(pages, picked)
    rows = plan.marked_rows(pages, carry)
    rows, slots = plan.events(rows)
    firsts = [
        structure.first_below(e, with_self=with_self).alias(f"f_{e}")
        for _, _, e, with_self in slots
    ]
    if listed:
        rows = rows.withColumn("found", plan.list_events())
    boxes = rows.select("*", *firsts)
    boxes = boxes.filter("is_box or size(found) > 0") if listed else boxes.filter("is_box")
    # One projection per step: each value is referred to by name, not repeated inside the next.
    keep = ["page_id", *carry, "index", "cfg", F.col("node_id").alias("box_id")]
    found: dict[tuple[str, int], list[str]] = {}
    for name, rank, e, _ in slots:
        found.setdefault((name, rank), []).append(e)
    values = [F.expr(f"if(f_{e}.n <= end_id, f_{e}.v, null)").alias(f"v_{e}") for _, _, e, _ in slots]
    extra = list(plan.box_values)
    if listed:
        own = [*carry, "index", "cfg", *extra, *[f"v_{e}" for _, _, e, _ in slots], *plan.regex_column.values()]
        marked = boxes.select("page_id", "node_id", "end_id", "is_box", (F.size("found") > 0).alias("is_event"), "found", *carry, "index", "cfg", *extra, *values, *plan.regex_column.values())
        boxes = _with_lists(enclosing(marked, "is_box", "is_event", ["found"], tuple(own)), own, listed)
    else:
        boxes = boxes.select(*keep, *extra, *values, *plan.regex_column.values())
    keep[-1] = "box_id"
    keep += extra
    raw, done, steps = [], [], {}
    for i, need in enumerate(n for n in plan.needs if n.selector.kind != "never" and n.field != listed):
        if need.selector.kind == "regex":
            value = plan.regex_column[need.selector.pattern]
        else:
            value = f"coalesce({', '.join(f'v_{e}' for e in found[(need.field, need.rank)])})"
        if cleaning != "raw":
            value = f"nullif(nullif({value}, ''), {literal(MISSING)})"
        # A slot is shared by configurations: a value counts for the one that asked for it.
        if len(plan.configs) > 1:
            value = f"if(cfg = {need.config}, {value}, null)"
        raw.append(F.expr(value).alias(f"u{i}"))
        done.append(plan.finish(need, F.col(f"u{i}")).alias(f"u{i}"))
        steps.setdefault(need.field, []).append((need.rank, f"u{i}"))
    columns = [
        F.expr(f"coalesce({', '.join(u for _, u in sorted(steps.get(name, [])))})")
        if name in steps
        else F.lit(None).cast("string")
        for name in fields
    ]
    columns = [c.alias(name) for c, name in zip(columns, fields)]
    if listed:
        keep.append(listed)
    return boxes.select(*keep, *raw).select(*keep, *done).select(*keep, *columns).drop("cfg")


def parse_once(pages: DataFrame, *uses: tuple[Mapping[str, Config], tuple[str, ...]]) -> DataFrame:
    """The `parse_pages` result that serves the extraction of each of these (configurations, fields): store it and hand it to
    `extract_rows` as `parsed`, for several extractions of the same pages."""
    options = [_Plan(configs, fields).parse_options() for configs, fields in uses]
    return parse_pages(
        pages,
        texts=tuple(dict.fromkeys(t for o in options for t in o["texts"])),
        **{name: any(o[name] for o in options) for name in ("parent_attrs", "parent_text")},
    )


def _with_lists(owned: DataFrame, own: list[str], listed: str) -> DataFrame:
    """Boxes with their own columns and the values of the events inside them, in selector then document order, repeats dropped.

    The values of one container come from one page, so a list is no larger than its page.
    """
    at = F.transform("found", lambda f: F.struct(f["rank"].alias("rank"), F.col("node_id").alias("node_id"), f["v"].alias("v")))
    values = F.array_sort(F.flatten(F.collect_list(at)))
    return owned.groupBy("page_id", "box_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in own], F.array_distinct(F.transform(values, lambda x: x["v"])).alias(listed)
    )


def extract_lists(
    pages: DataFrame, configs: Mapping[str, Config], name: str, picked: str | None = None
) -> DataFrame:
    """All values of a multi-valued field per container that has any: (page_id, box_id, values), every match of
    every selector in selector then document order, repeats dropped."""
    rows = extract_rows(pages, configs, (), cleaning="strip", picked=picked, listed=name)
    return rows.filter(F.size(name) > 0).select("page_id", "box_id", F.col(name).alias("values"))


def valid_product(name: str = "name", price: str = "current_price") -> Column:
    """Name or price present, and a present name at least two characters long."""
    return (F.col(name).isNotNull() | F.col(price).isNotNull()) & (
        F.col(name).isNull() | (F.length(name) >= 2)
    )


def extract_products(
    pages: DataFrame, configs: Mapping[str, Config] | DataFrame, scraped_at: Column | None = None, parsed: DataFrame | None = None
) -> DataFrame:
    """Product rows that pass the validity filter. `index` keeps the container's position, so gaps
    show what was dropped; missing values are NULL (see sinks.stored_products for the stored form)."""
    rows = extract_rows(pages, configs, parsed=parsed).filter(valid_product())
    out = rows
    if "site" not in rows.columns:
        out = out.withColumn("site", F.lit("unknown"))
    if "scraped_at" not in rows.columns:
        when = F.lit(None).cast("timestamp") if scraped_at is None else scraped_at
        out = out.withColumn("scraped_at", when)
    return out.drop("box_id")
