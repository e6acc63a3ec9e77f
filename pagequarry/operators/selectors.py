"""Selector strings to predicates on node rows.

Supported CSS: tag, .class, #id, [a], [a="v"], [a*=], [a^=], [a$=], [a~=], descendant (blank),
adjacent (+) and comma lists. `:contains("t")` standing in a single selector is a text search: `t`
is a case-insensitive regex over strings, whatever the tag in front. Supported XPath: `.//` or `//`
steps with @a, @a="v", contains(@a,"v"), starts-with(@a,"v") and position predicates, ending in an
element, /text(), //text() or /@a. Anything else raises UnsupportedSelector.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pagequarry.functions.text import pattern_group


class UnsupportedSelector(ValueError):
    """The selector lies outside the supported grammar."""


TEXT_SQL = "cast(substr(stripped, stripped_s + 1, stripped_e - stripped_s) as string)"


def literal(text: str) -> str:
    """A string as a SQL literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


@dataclass(frozen=True)
class Test:
    """What one step asks of one element."""

    tag: str | None = None
    tokens: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str], ...] = ()  # (operator, attribute, value)
    position: int | None = None
    holds: str | None = None  # text the element must contain (selector lists only)

    def names(self) -> set[str]:
        """Attributes the test looks at."""
        return {name for _, name, _ in self.attrs} | ({"class"} if self.tokens else set())

    def sql(self, cells: Mapping[str, str] | None = None) -> str:
        """The test as one SQL predicate on a node row; never NULL. `cells` names columns that
        already hold an attribute."""

        def cell(name: str) -> str:
            return (cells or {}).get(name) or f"attrs[{literal(name)}]"

        def has_token(name: str, token: str) -> str:
            return f"contains(concat(' ', {cell(name)}, ' '), {literal(f' {token} ')})"

        terms = ["kind = 'e'"]
        if self.tag:
            terms.append(f"tag = {literal(self.tag)}")
        if self.position is not None:
            terms.append(f"same_tag_idx = {self.position}")
        terms += [has_token("class", token) for token in self.tokens]
        for operator, name, value in self.attrs:
            needle = literal(value)
            if operator == "has":
                terms.append(f"{cell(name)} is not null")
            elif operator == "=":
                terms.append(f"{cell(name)} = {needle}")
            elif value == "":
                terms.append("false")  # an empty needle matches nothing
            elif operator == "~=":
                terms.append(has_token(name, value))
            else:
                shape = {"*=": "contains", "^=": "startswith", "$=": "endswith"}[operator]
                terms.append(f"{shape}({cell(name)}, {needle})")
        if self.holds is not None:
            terms.append(f"contains({TEXT_SQL}, {literal(self.holds)})")
        return f"coalesce({' and '.join(terms)}, false)"


@dataclass(frozen=True)
class Picked(Test):
    """An element whose node id is listed in an array column of its page."""

    column: str = "box_ids"

    def sql(self, cells: Mapping[str, str] | None = None) -> str:
        return f"coalesce(kind = 'e' and array_contains({self.column}, node_id), false)"


# A join of a path whose next step is any element around the one before.
HOLDS = "holds"


@dataclass(frozen=True)
class Path:
    """Steps from the outermost to the matched one; joins[i] links step i to step i + 1."""

    steps: tuple[Test, ...]
    joins: tuple[str, ...] = ()


@dataclass(frozen=True)
class Selector:
    """kind: css (alternatives, whole-page ancestors), search (regex over strings), xpath (one path,
    ancestors inside the container), find (first hit of each step inside the one before), regex (over
    the container's text), never (can match nothing). take: what a match yields - text, string (its
    first string, or the searched string itself), strings (any string below), @name.
    """

    kind: str
    paths: tuple[Path, ...] = ()
    take: str = "text"
    pattern: str = ""
    from_root: bool = False


NEVER = Selector("never")

_NAME = r"[A-Za-z_ -￿-][\w -￿-]*"
_PART = re.compile(
    rf"(?P<tag>\*|{_NAME})|\.(?P<token>{_NAME})|#(?P<id>{_NAME})"
    r"|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]"
    r"|:contains\((?P<holds>\"[^\"]*\"|'[^']*'|[^)]*)\)"
)


def _unquote(text: str | None) -> str:
    text = text or ""
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _compound(text: str) -> Test:
    tag, tokens, attrs, holds, at = None, [], [], None, 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["tag"] and at):
            raise UnsupportedSelector(text)
        if m["tag"]:
            tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["token"]:
            tokens.append(m["token"])
        elif m["id"]:
            attrs.append(("=", "id", m["id"]))
        elif m["attr"]:
            attrs.append((m["op"] or "has", m["attr"].lower(), _unquote(m["value"])))
        else:
            holds = _unquote(m["holds"])
        at = m.end()
    if not text:
        raise UnsupportedSelector("empty step")
    return Test(tag, tuple(tokens), tuple(attrs), None, holds)


def _pieces(text: str, separators: str) -> list[tuple[str, str]]:
    """(separator before, piece) pairs, leaving quotes and brackets whole."""
    out, piece, before, quote, nested = [], "", "", "", 0
    for ch in text.strip():
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "[(":
            nested += 1
        elif ch in "])":
            nested -= 1
        elif not nested and ch in separators:
            if piece:
                out.append((before, piece))
                piece, before = "", ""
            if not before.strip():
                before = ch
            continue
        piece += ch
    if piece:
        out.append((before, piece))
    return out


def _css_path(text: str) -> Path:
    steps, joins = [], []
    for before, piece in _pieces(text, " \t\n+>~"):
        join = before.strip() or " "
        if join not in " +":
            raise UnsupportedSelector(text)
        if steps:
            joins.append(join)
        elif join != " ":
            raise UnsupportedSelector(text)
        steps.append(_compound(piece))
    if not steps:
        raise UnsupportedSelector(text)
    return Path(tuple(steps), tuple(joins))


def compile_css(text: str, lists: bool = False, unquoted_search: bool = False) -> Selector:
    """`lists` reads :contains as a test on the element (schema selectors); otherwise it is the
    text search, whose unquoted form matches nothing unless `unquoted_search` accepts it."""
    if ":contains(" in text and not lists:
        found = re.search(r':contains\("(.*?)"\)', text, re.S)
        if found is None and unquoted_search:
            found = re.search(r":contains\(['\"]?(.*?)['\"]?\)", text, re.S)
        if found is None or pattern_group(found[1]) is None:
            return NEVER
        return Selector("search", pattern=found[1])
    paths = tuple(_css_path(p) for _, p in _pieces(text, ","))
    if not paths:
        raise UnsupportedSelector("empty selector")
    return Selector("css", paths)


_XPATH_STEP = re.compile(r"(?P<axis>//|/)(?P<node>text\(\)|@[\w-]+|\*|[\w-]+)(?P<preds>(?:\[[^\]]*\])*)")
_XPATH_TESTS = (
    (re.compile(r"@([\w-]+)$"), "has"),
    (re.compile(r"@([\w-]+)\s*=\s*(\"[^\"]*\"|'[^']*')$"), "="),
    (re.compile(r"contains\(\s*@([\w-]+)\s*,\s*(\"[^\"]*\"|'[^']*')\s*\)$"), "*="),
    (re.compile(r"starts-with\(\s*@([\w-]+)\s*,\s*(\"[^\"]*\"|'[^']*')\s*\)$"), "^="),
)


def _xpath_test(tag: str, preds: str) -> Test:
    attrs, position = [], None
    for body in re.findall(r"\[([^\]]*)\]", preds):
        for term in body.split(" and "):
            term = term.strip()
            if term.isdigit():
                position = int(term)
                continue
            for shape, operator in _XPATH_TESTS:
                m = shape.match(term)
                if m:
                    value = _unquote(m[2]) if operator != "has" else ""
                    attrs.append((operator, m[1].lower(), value))
                    break
            else:
                raise UnsupportedSelector(term)
    return Test(None if tag == "*" else tag.lower(), (), tuple(attrs), position)


def compile_xpath(text: str) -> Selector:
    body = text.strip()
    from_root = body.startswith("//")
    body = body if from_root else body.removeprefix(".")
    steps, take, at = [], "text", 0
    while at < len(body):
        m = _XPATH_STEP.match(body, at)
        if not m or take != "text":
            raise UnsupportedSelector(text)
        node, axis = m["node"], m["axis"]
        if node == "text()":
            take = "string" if axis == "/" else "strings"
        elif node[0] == "@":
            take = node
            if axis == "//":
                raise UnsupportedSelector(text)
        elif axis == "/":
            raise UnsupportedSelector(f"child step in {text}")
        else:
            steps.append(_xpath_test(node, m["preds"]))
        at = m.end()
    if not steps:
        raise UnsupportedSelector(text)
    if take.startswith("@"):
        last = steps[-1]
        held = (*last.attrs, ("has", take[1:].lower(), ""))
        steps[-1] = Test(last.tag, last.tokens, held, last.position)
    return Selector("xpath", (Path(tuple(steps), (" ",) * (len(steps) - 1)),), take, from_root=from_root)


def compile_find(text: str) -> Selector:
    """`a >> b`: the first a, then the first b inside that very a."""
    return Selector("find", (Path(tuple(_compound(part.strip()) for part in text.split(">>"))),))


def compile_selector(type_: str | None, selector: str, regex: str | None = None, **css) -> Selector:
    """An unknown type counts as css; a selector outside the grammar raises UnsupportedSelector."""
    if type_ == "xpath":
        return compile_xpath(selector)
    if type_ == "find":
        return compile_find(selector)
    if type_ == "string":
        return NEVER if pattern_group(selector) is None else Selector("search", take="string", pattern=selector)
    if type_ == "regex":
        bad = not regex or pattern_group(regex) is None
        return NEVER if bad else Selector("regex", pattern=regex)
    return compile_css(selector, **css)
