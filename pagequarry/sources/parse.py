"""Pages to document-order node rows.

`parse_pages` is the only Python step of the engine: it reads each page once and returns one array
of nodes per page, next to the page's text as bytes. A node keeps offsets into that text, so the
text of any element is a constant-time slice and no ancestor stores a copy of its descendants' text.
Everything after it is DataFrame work.

A large page is emitted in several rows. Each carries its own slice of the page's texts; elements that reach
beyond their row's nodes come in rows of their own after them, with the text they cover, so a
byte of text is written at most twice however many rows a page has.

Tree rules: void and self-closed elements close at once, an end tag closes up to the nearest open
element of that name and is ignored if there is none, an unclosed element stays open until an
ancestor closes. Of duplicate attributes the last wins; class values are blank-separated tokens.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.schema import NODE_FIELDS

# The reader travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content, and elements whose strings are not page text.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
NOT_PAGE_TEXT = frozenset("script style template rt rp".split())

# A page is emitted in rows of at most this many nodes (but for `whole`), so a row does not grow with the page.
NODES_PER_ROW = 16384
# Rows are handed to Spark once a batch holds about this many nodes or text bytes.
BATCH_NODES = 65536
BATCH_BYTES = 16 << 20

# raw: every string but comments; plain: page text; stripped: page text with each string trimmed.
TEXTS = ("raw", "plain", "stripped")

ROOT = -1


# Positions in a node record while its page is being read; spans of each text follow.
KIND, TAG, PARENT, DEPTH, END, ATTRS, CHILDREN, SIB, SAME, STRING, STRING_ID, SPANS = range(12)


class _Page(HTMLParser):
    """Collects one page's nodes as records in document order."""

    def __init__(self, html: str, texts: tuple[str, ...], source: bool, parent_text: bool = True):
        super().__init__(convert_charrefs=True)
        self.texts, self.source, self.parent_text = texts, source, parent_text
        self.nodes: list[list] = []
        self.blobs = [bytearray() for _ in texts]
        # Strings of scripts and the like go behind the page text, out of their ancestors' spans.
        self.aside = [bytearray() for _ in texts]
        self.aside_spans: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        self.open: list[int] = []
        self.open_names: dict[str, int] = {}
        self.off_text = 0
        self.near: list[int | None] | None = None
        self.siblings: dict[int, dict[str, int]] = {}
        self.pending: list[str] = []
        # Strings of the raw text, and per node which of them it starts before and ends after.
        self.runs: list[str] = []
        self.run_lo: list[int] = []
        self.run_hi: list[int] = []
        # Per string node its own span in the stripped text, and whether that was set aside.
        self.own: dict[int, tuple[int, int, bool]] = {}
        if source:
            self.html, self.ascii = html, html.isascii()
            self.html_bytes = html.encode("utf-8", "replace")
            self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
            self.mark = (0, 0)
        self.feed(html)
        self.close()
        self._flush()
        while self.open:
            self._pop(len(html))
        self._settle_texts()

    def _settle_texts(self):
        """Place the texts set aside. Strings get their parent's spans if wanted (what a text search
        returns is the text of the parent), else none."""
        self.text_end = [len(blob) for blob in self.blobs]
        for t, blob in enumerate(self.blobs):
            at, base = SPANS + 2 * t, len(blob)
            for i, (s, e) in self.aside_spans[t].items():
                self.nodes[i][at : at + 2] = base + s, base + e
            blob += self.aside[t]
        whole = [x for blob in self.blobs for x in (0, len(blob))]
        none = [None] * len(whole)
        stop = SPANS + 2 * len(self.texts)
        for node in self.nodes:
            if node[KIND] != "e":
                p = node[PARENT]
                above = whole if p == ROOT else self.nodes[p][SPANS:stop]
                node[SPANS:stop] = above if self.parent_text else none

    # -- building -----------------------------------------------------------------------------

    def _add(self, kind, tag, attrs, string):
        parent = self.open[-1] if self.open else ROOT
        number = len(self.nodes)
        sib = same = string_id = None
        if kind == "e":
            counts = self.siblings.get(parent)
            if counts is None:
                counts = self.siblings[parent] = {"": 0}
            sib = counts[""] = counts[""] + 1
            same = counts[tag] = counts.get(tag, 0) + 1
            if parent != ROOT:
                self.nodes[parent][CHILDREN] += 1
        else:
            string_id = number
            if kind == "t" and parent != ROOT and self.nodes[parent][STRING] is None:
                self.nodes[parent][STRING], self.nodes[parent][STRING_ID] = string, number
        node = [kind, tag, parent, len(self.open), number, attrs, 0, sib, same, string, string_id]
        for blob in self.blobs:
            node += (len(blob), len(blob))
        if self.source:
            at = self._byte(self._pos()) if kind == "e" else None
            node += (at, at, self.getpos()[0])
        self.nodes.append(node)
        self.run_lo.append(len(self.runs))
        self.run_hi.append(len(self.runs))
        return number

    def _flush(self):
        if self.pending:
            string = "".join(self.pending) if len(self.pending) > 1 else self.pending[0]
            self.pending.clear()
            self._add("t", None, (), string)
            self._keep(string)

    def _keep(self, string, in_raw=True):
        """Append a string to the page texts it belongs to."""
        for t, text in enumerate(self.texts):
            if text == "raw":
                if in_raw:
                    self.blobs[t] += string.encode("utf-8", "replace")
                    self.runs.append(string)
                continue
            data = (string.strip() if text == "stripped" else string).encode("utf-8", "replace")
            if text == "stripped" and data:
                start = len(self.aside[t] if self.off_text else self.blobs[t])
                self.own[len(self.nodes) - 1] = (start, start + len(data), bool(self.off_text))
            if self.off_text:
                start = len(self.aside[t])
                self.aside[t] += data
                spans, owner = self.aside_spans[t], self.open[-1]
                spans[owner] = (spans.get(owner, (start, 0))[0], start + len(data))
            else:
                self.blobs[t] += data

    def _pop(self, at):
        number = self.open.pop()
        tag = self.nodes[number][TAG]
        self.open_names[tag] -= 1
        if tag in NOT_PAGE_TEXT:
            self.off_text -= 1
        self._close(number, at)

    def _close(self, number, at):
        node = self.nodes[number]
        node[END] = len(self.nodes) - 1
        self.run_hi[number] = len(self.runs)
        for t, blob in enumerate(self.blobs):
            node[SPANS + 2 * t + 1] = len(blob)
        if self.source:
            node[-2] = self._byte(at)

    def nearest(self, tag: str) -> list[int | None]:
        """Per node the closest enclosing element of a tag: its parent, or the parent's own answer."""
        if self.near is None:
            self.near = near = []
            for node in self.nodes:
                p = node[PARENT]
                near.append(None if p == ROOT else p if self.nodes[p][TAG] == tag else near[p])
        return self.near

    # -- measures of the raw text -------------------------------------------------------------

    def sizes(self) -> Iterator[tuple[int, int, int] | None]:
        """Per element (first byte, past the last byte, characters) of its raw text without blanks at the ends.

        Element bounds are string bounds, so the first string with content from the lower bound on and
        the last one before the upper bound decide: two lookups, whatever the element's text.
        """
        chars, firsts, lasts = 0, [], []
        byte = 0
        for run in self.runs:
            lead, kept = len(run) - len(run.lstrip()), run.rstrip()
            content = (
                byte + len(run[:lead].encode("utf-8", "replace")),
                byte + len(kept.encode("utf-8", "replace")),
                chars + lead,
                chars + len(kept),
            )
            firsts.append(content if kept else None)
            byte += len(run.encode("utf-8", "replace"))
            chars += len(run)
        lasts = firsts[:]
        for i in range(len(firsts) - 2, -1, -1):
            firsts[i] = firsts[i] or firsts[i + 1]
        for i in range(1, len(lasts)):
            lasts[i] = lasts[i] or lasts[i - 1]
        for node, lo, hi in zip(self.nodes, self.run_lo, self.run_hi):
            if node[KIND] != "e":
                yield None
                continue
            first, last = (firsts[lo], lasts[hi - 1]) if hi > lo else (None, None)
            # Nothing but blanks: the nearest strings with content lie outside.
            if first is None or last is None or first[0] >= last[1]:
                yield 0, 0, 0
            else:
                yield first[0], last[1], last[3] - first[2]

    def longest_strings(self) -> dict[int, tuple[int, int]]:
        """Per element the span, in the stripped text, of the longest string below it, the first of equal ones."""
        t = self.texts.index("stripped")
        best: dict[int, tuple] = {}
        for number in range(len(self.nodes) - 1, -1, -1):
            if number in self.own:
                s, e, aside = self.own[number]
                blob = self.aside[t] if aside else self.blobs[t]
                shift = self.text_end[t] if aside else 0
                best[number] = (len(blob[s:e].decode()), -number, s + shift, e + shift)
            p = self.nodes[number][PARENT]
            if p != ROOT and number in best and (p not in best or best[p] < best[number]):
                best[p] = best[number]
        return {number: found[2:] for number, found in best.items() if self.nodes[number][KIND] == "e"}

    def word_pieces(self, of_word: re.Pattern) -> list[tuple[str, int, int, int]]:
        """The texts of all text elements (those whose first direct string is not blank) for counting words: (text, number of
        text elements that hold it, node id of the first of them, place).

        A stretch of text is given once with the number of elements around it, not once per element. Words that run over
        a border of strings are cut out: elements around all of the word's strings see it whole, and each one whose
        bound lies within it sees its own part.
        """
        n = len(self.runs)
        texts = [
            (number, lo, hi)
            for number, (node, lo, hi) in enumerate(zip(self.nodes, self.run_lo, self.run_hi))
            if node[KIND] == "e" and hi > lo and node[STRING] is not None and node[STRING].strip()
        ]
        change, owner, reach = [0] * (n + 1), [0] * n, 0
        starts: dict[int, list] = {}
        ends: dict[int, list] = {}
        for element in texts:
            number, lo, hi = element
            change[lo] += 1
            change[hi] -= 1
            starts.setdefault(lo, []).append(element)
            ends.setdefault(hi, []).append(element)
            if lo >= reach:
                owner[lo:hi] = [number] * (hi - lo)
                reach = hi
        cover, open_now = [], 0
        for k in range(n):
            open_now += change[k]
            cover.append(open_now)
        heads = [of_word.match(r).end() for r in self.runs]
        tails = [heads[k] if heads[k] == len(r) else len(of_word.match(r[::-1])[0]) for k, r in enumerate(self.runs)]
        out, k = [], 0
        while k < n:
            # A chain of strings whose borders lie inside words.
            last = k
            while last + 1 < n and tails[last] and heads[last + 1]:
                last += 1
            for i in range(k, last + 1):
                run = self.runs[i]
                whole = heads[i] == len(run)
                if cover[i] and not (whole and last > k):
                    inner = run[heads[i] if i > k else 0 : len(run) - (tails[i] if i < last else 0)]
                    if inner:
                        out.append((inner, cover[i], owner[i], 2 * i + 1))
            a = k
            while a < last:
                # One word: from the end of string a through strings that are all letters to the start of string b.
                b = a + 1
                while b < last and heads[b] == len(self.runs[b]):
                    b += 1
                parts = [self.runs[a][len(self.runs[a]) - tails[a] :], *self.runs[a + 1 : b], self.runs[b][: heads[b]]]
                bounded = {e for i in range(a + 1, b + 1) for e in (*starts.get(i, ()), *ends.get(i, ()))}
                around = cover[a] - sum(1 for _, lo, hi in bounded if lo <= a < hi)
                if around:
                    out.append(("".join(parts), around, owner[a], 2 * a + 2))
                for number, lo, hi in bounded:
                    place = 2 * a + 2 if lo <= a else 2 * lo
                    out.append(("".join(parts[max(lo, a) - a : min(hi, b + 1) - a]), 1, number, place))
                a = b
            k = last + 1
        return out

    def same_source(self, tag: str) -> dict[int, int]:
        """Per element of a tag the first one of the page with the very same source text.

        Two rolling sums over the source's bytes, taken at element bounds, name the text of any element in constant
        time; a first repeat is compared byte for byte, those nested in it at equal places need no comparison.
        """
        marks = sorted({at for node in self.nodes if node[TAG] == tag for at in (node[-3], node[-2])})
        primes = ((1 << 61) - 1, (1 << 89) - 1)
        sums: dict[int, tuple[int, int]] = {}
        now, before = [0, 0], 0
        for at in marks:
            piece = self.html_bytes[before:at]
            number = int.from_bytes(piece, "big")
            for i in (0, 1):
                now[i] = (now[i] * pow(256, len(piece), primes[i]) + number % primes[i]) % primes[i]
            sums[at], before = (now[0], now[1]), at
        known: dict[tuple, int] = {}
        out: dict[int, int] = {}
        # The repeat that encloses the current element, and its first copy.
        outer, first_outer = ROOT, ROOT
        for number, node in enumerate(self.nodes):
            if node[TAG] != tag:
                continue
            s, e = node[-3], node[-2]
            name = (e - s, *((sums[e][i] - sums[s][i] * pow(256, e - s, primes[i])) % primes[i] for i in (0, 1)))
            first = known.setdefault(name, number)
            if first != number:
                nested = outer != ROOT and number <= self.nodes[outer][END] and self.nodes[first][-3] - self.nodes[first_outer][-3] == s - self.nodes[outer][-3]
                if not nested:
                    f = self.nodes[first]
                    if self.html_bytes[f[-3] : f[-2]] != self.html_bytes[s:e]:
                        first = number
                    elif outer == ROOT or number > self.nodes[outer][END]:
                        outer, first_outer = number, first
            out[number] = first
        return out

    # -- source positions ---------------------------------------------------------------------

    def _pos(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _byte(self, at):
        """Byte offset of a character offset; offsets move forward, so this is linear in all."""
        if self.ascii:
            return at
        char, byte = self.mark
        if at >= char:
            byte += len(self.html[char:at].encode("utf-8", "replace"))
        else:
            byte -= len(self.html[at:char].encode("utf-8", "replace"))
        self.mark = (at, byte)
        return byte

    # -- events -------------------------------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        self._flush()
        number = self._add("e", tag, attrs, None)
        if tag in VOID:
            self._close(number, self._tag_end())
        else:
            self.open.append(number)
            self.open_names[tag] = self.open_names.get(tag, 0) + 1
            if tag in NOT_PAGE_TEXT:
                self.off_text += 1

    def handle_startendtag(self, tag, attrs):
        self._flush()
        self._close(self._add("e", tag, attrs, None), self._tag_end())

    def _tag_end(self):
        return self._pos() + len(self.get_starttag_text()) if self.source else 0

    def handle_endtag(self, tag):
        self._flush()
        if not self.open_names.get(tag):
            return
        here = stop = 0
        if self.source:
            here = self._pos()
            stop = self.html.find(">", here) + 1 or len(self.html)
        while self.nodes[self.open[-1]][TAG] != tag:
            self._pop(here)
        self._pop(stop)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()
        self._add("c", None, (), data)

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._flush()
        if data[:6].upper() == "CDATA[":
            self._add("t", None, (), data[6:])
            self._keep(data[6:], in_raw=False)
        else:
            self._add("c", None, (), data)


# Output member and record position.
RECORD = (
    ("end_id", END),
    ("parent_id", PARENT),
    ("depth", DEPTH),
    ("kind", KIND),
    ("tag", TAG),
    ("child_count", CHILDREN),
    ("sib_idx", SIB),
    ("same_tag_idx", SAME),
    ("text", STRING),
    ("text_id", STRING_ID),
)


def _attributes(pairs) -> dict[str, str]:
    out = {}
    for key, value in pairs:
        value = value or ""
        out[key] = " ".join(value.split()) if key == "class" else value
    return out


class _Batch:
    """Node columns of several page rows, turned into one Arrow batch."""

    def __init__(self, texts, xpath, source, parent_attrs, nearest, sizes=False, same=None, words=None, longest=False):
        self.texts, self.xpath, self.source, self.nearest = texts, xpath, source, nearest
        self.parent_attrs, self.sizes, self.same, self.words = parent_attrs, sizes, same, words
        self.rows, self.parts, self.errors, self.starts = [], [], [], [0]
        names = [f.name for f in NODE_FIELDS if f.name != "attrs"]
        names += (["line"] if source else []) + (["near_id"] if nearest else [])
        names += (["same_id"] if same else []) + (["trim_s", "trim_e", "size"] if sizes else [])
        names += ["long_s", "long_e"] if longest else []
        self.longest = longest
        self.columns = {name: [] for name in names}
        self.keys, self.values, self.attr_starts = [], [], [0]
        self.paths: list[str | None] = []
        self.pieces: list[list[tuple]] = []
        self.blobs = {t: [] for t in texts + (("source",) if source else ())}
        self.spans = {t: ([], []) for t in self.blobs}
        self.size = 0

    def add(self, row, page: _Page | None, ids=(), part=0, error=None, facts=None):
        self.rows.append(row)
        self.errors.append(error)
        self.parts.append(part)
        self.pieces.append(page.word_pieces(self.words) if self.words and page is not None and not part else [])
        if page is not None:
            self._add_nodes(page, ids, facts)
        else:
            for blob in self.blobs.values():
                blob.append(b"")
        self.starts.append(len(self.columns["node_id"]))

    def _add_nodes(self, page, ids, facts):
        nodes = [page.nodes[i] for i in ids]
        members = list(zip(*nodes))
        self.columns["node_id"].extend(ids)
        for name, at in RECORD:
            self.columns[name].extend(members[at])
        keys, values, starts = self.keys, self.values, self.attr_starts
        for node in nodes:
            pairs = node[ATTRS]
            if self.parent_attrs and node[KIND] != "e" and node[PARENT] != ROOT:
                pairs = page.nodes[node[PARENT]][ATTRS]
            if pairs:
                for key, value in _attributes(pairs).items():
                    keys.append(key)
                    values.append(value)
            starts.append(len(keys))
        if self.xpath:
            self.paths.extend(facts["xpath"][i] for i in ids)
        if self.source:
            self.columns["line"].extend(members[-1])
        if self.nearest:
            near = page.nearest(self.nearest)
            self.columns["near_id"].extend(near[i] for i in ids)
        if self.same:
            self.columns["same_id"].extend(facts["same"].get(i) for i in ids)
        if self.sizes:
            for at, name in enumerate(("trim_s", "trim_e", "size")):
                self.columns[name].extend(None if facts["sizes"][i] is None else facts["sizes"][i][at] for i in ids)
        for name, blob in self.blobs.items():
            t = len(page.texts) if name == "source" else page.texts.index(name)
            text_end = None if name == "source" else page.text_end[t]
            data = page.html_bytes if name == "source" else page.blobs[t]
            at = SPANS + 2 * t
            starts, stops = members[at], members[at + 1]
            # The row's own slice, then the texts that stand behind the page's.
            here = [(s, e) for s, e in zip(starts, stops) if s is not None and (text_end is None or s < text_end or s == e)]
            low = min((s for s, _ in here), default=0)
            high = max((e for _, e in here), default=0)
            kept = data[low:high]
            spans = self.spans[name]
            aside: dict[tuple[int, int], int] = {}

            def place(s, e):
                nonlocal kept
                if s is None:
                    return None, None
                if text_end is None or s < text_end or s == e:
                    return s - low, e - low
                if (s, e) not in aside:
                    aside[s, e] = len(kept) - s
                    kept = kept + data[s:e]
                return s + aside[s, e], e + aside[s, e]

            for s, e in zip(starts, stops):
                s, e = place(s, e)
                spans[0].append(s)
                spans[1].append(e)
            if self.longest and name == "stripped":
                for i in ids:
                    s, e = place(*facts["longest"].get(i, (None, None)))
                    self.columns["long_s"].append(s)
                    self.columns["long_e"].append(e)
            if self.sizes and name == "raw":
                first = len(self.columns["trim_s"]) - len(ids)
                for column in ("trim_s", "trim_e"):
                    cells = self.columns[column]
                    cells[first:] = [None if c is None else max(c - low, 0) for c in cells[first:]]
            blob.append(bytes(kept))
            self.size += len(kept)

    def full(self):
        return len(self.columns["node_id"]) >= BATCH_NODES or self.size >= BATCH_BYTES

    def to_arrow(self, kept: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        taken = kept.take(pa.array(self.rows, pa.int64()))
        arrays, node_type = list(taken.columns), schema.field("nodes").type.value_type
        members = []
        for field in node_type:
            if field.name == "attrs":
                members.append(
                    pa.MapArray.from_arrays(
                        pa.array(self.attr_starts, pa.int32()),
                        pa.array(self.keys, pa.string()),
                        pa.array(self.values, pa.string()),
                    )
                )
            elif field.name == "xpath":
                members.append(pa.array(self.paths, pa.string()))
            elif field.name in self.columns:
                members.append(pa.array(self.columns[field.name], field.type))
            else:
                text, side = field.name.rsplit("_", 1)  # a span of one of the texts
                members.append(pa.array(self.spans[text][side == "e"], pa.int32()))
        nodes = pa.StructArray.from_arrays(members, names=[f.name for f in node_type])
        arrays.append(pa.array(self.parts, pa.int32()))
        arrays.append(pa.array(self.errors, pa.string()))
        arrays.append(pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), nodes))
        arrays.extend(pa.array(self.blobs[t], pa.binary()) for t in self.blobs)
        if self.words:
            names = ("text", "weight", "owner", "place")
            arrays.append(pa.array([[dict(zip(names, p)) for p in row] for row in self.pieces], schema.field("pieces").type))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _xpaths(page: _Page) -> Iterator[str | None]:
    """Absolute path of each element, indexed only among same-tag siblings, in document order."""
    above: list[str] = []
    for node in page.nodes:
        if node[KIND] != "e":
            yield None
            continue
        del above[node[DEPTH] :]
        tag = node[TAG]
        alone = page.siblings[node[PARENT]][tag] == 1
        above.append(tag if alone else f"{tag}[{node[SAME]}]")
        yield "/" + "/".join(above)


def _rows_of(page: _Page, limit: int, split: bool) -> Iterator[list[int]]:
    """Node ids of each output row: runs of `limit` nodes and, where texts or sources are kept, the nodes that reach beyond
    their run in rows after them."""
    total = len(page.nodes)
    across: list[int] = []
    for lo in range(0, total, limit):
        hi = min(lo + limit, total)
        if not split or total <= limit:
            yield list(range(lo, hi))
            continue
        own = []
        for i in range(lo, hi):
            node = page.nodes[i]
            if node[KIND] == "e":
                beyond = node[END] >= hi
            else:
                # With the parent's text a string stands where its parent does.
                p = node[PARENT]
                beyond = page.parent_text and (p == ROOT or p < lo or page.nodes[p][END] >= hi)
            (across if beyond else own).append(i)
        if own:
            yield own
    most = max(limit, -(-total // 4))
    for lo in range(0, len(across), most):
        yield across[lo : lo + most]


def parse_pages(
    pages: DataFrame,
    texts: tuple[str, ...] = ("stripped",),
    xpath: bool = False,
    source: bool = False,
    parent_attrs: bool = False,
    nearest: str | None = None,
    html: str = "html",
    parent_text: bool = False,
    sizes: bool = False,
    same: str | None = None,
    words: str | None = None,
    longest: bool = False,
    whole: bool = False,
) -> DataFrame:
    """One row per page (more for pages over NODES_PER_ROW nodes) with its node array.

    Output: every input column but the html, `part`, `parse_error`, `nodes`, and one BINARY column
    per requested text. Ask only for the texts you slice: this is the projection of the parse.
    `xpath` adds each element's path, `source` the html bytes and each element's span and first line in them,
    `parent_attrs` puts the parent's attributes on string rows, `parent_text` its text, `nearest` adds near_id, the closest
    enclosing element of that tag. `sizes` adds trim_s, trim_e and size: the span in the row's `raw` bytes and the length of
    each element's raw text without blanks at its ends, in constant time per element. `same` adds same_id to elements of that
    tag: the first one of the page with the very same source. `words`, a class of characters, adds the column
    `pieces` (text, weight, owner, place), from which words of all text elements are counted, see `_Page.word_pieces`.
    `longest` adds long_s and long_e, the span in the row's `stripped` bytes of the longest string below an element.
    `whole` keeps a page in one row, for reports over a page's whole array: the row then grows with the
    page, as its html does. NULL and blank pages yield no row; a page that cannot be read yields one row without nodes and a
    `parse_error`.
    """
    if sizes and "raw" not in texts:
        texts = (*texts, "raw")
    if longest and "stripped" not in texts:
        texts = (*texts, "stripped")
    texts = tuple(t for t in TEXTS if t in texts)
    read_texts = texts if "raw" in texts or not words else ("raw", *texts)
    source_read = source or same is not None
    kept = [f for f in pages.schema.fields if f.name != html]
    members = list(NODE_FIELDS)
    if xpath:
        members.append(T.StructField("xpath", T.StringType()))
    blobs = texts + (("source",) if source else ())
    for t in blobs:
        members += [T.StructField(f"{t}_s", T.IntegerType()), T.StructField(f"{t}_e", T.IntegerType())]
    if source:
        members.append(T.StructField("line", T.IntegerType()))
    for name in [*(["near_id"] if nearest else []), *(["same_id"] if same else []), *(["trim_s", "trim_e", "size"] if sizes else []), *(["long_s", "long_e"] if longest else [])]:
        members.append(T.StructField(name, T.IntegerType()))
    pieces = "array<struct<text:string,weight:int,owner:int,place:int>>"
    schema = T.StructType(
        kept
        + [
            T.StructField("part", T.IntegerType()),
            T.StructField("parse_error", T.StringType()),
            T.StructField("nodes", T.ArrayType(T.StructType(members))),
        ]
        + [T.StructField(t, T.BinaryType()) for t in blobs]
        + ([T.StructField("pieces", T.DataType.fromDDL(pieces))] if words else [])
    )
    names = [f.name for f in kept]
    letters = re.compile(f"{words}*") if words else None
    limit = sys.maxsize if whole else NODES_PER_ROW

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def empty():
            return _Batch(texts, xpath, source, parent_attrs, nearest, sizes, same, letters, longest)

        for batch in batches:
            carried = batch.select(names)
            out = empty()
            for row, cell in enumerate(batch.column(html)):
                text = cell.as_py()
                if text is None or not text.strip():
                    continue
                try:
                    page = _Page(text, read_texts, source_read, parent_text)
                    facts = {
                        "xpath": list(_xpaths(page)) if xpath else None,
                        "sizes": list(page.sizes()) if sizes else None,
                        "same": page.same_source(same) if same else None,
                        "longest": page.longest_strings() if longest else None,
                    }
                except Exception as broken:  # one unreadable page must not fail the task
                    out.add(row, None, error=f"{type(broken).__name__}: {broken}")
                    continue
                for part, ids in enumerate(_rows_of(page, limit, bool(texts) or source)):
                    out.add(row, page, ids, part, facts=facts)
                    if out.full():
                        yield out.to_arrow(carried, arrow)
                        out = empty()
            if out.rows:
                yield out.to_arrow(carried, arrow)

    return pages.mapInArrow(read, schema)


def node_rows(parsed: DataFrame, elements_only: bool = True) -> DataFrame:
    """Explode parsed pages to one row per node. Page texts stay in reach until projected away."""
    keep = [c for c in parsed.columns if c not in ("nodes", "parse_error")]
    rows = parsed.select(*keep, F.explode("nodes").alias("n")).select(*keep, "n.*")
    return rows.filter(F.col("kind") == "e") if elements_only else rows


def node_text(flavour: str = "stripped") -> Column:
    """Text of a node row as a slice of its page's text bytes."""
    start, stop = F.col(f"{flavour}_s"), F.col(f"{flavour}_e")
    return F.substr(F.col(flavour), start + 1, stop - start).cast("string")


def outer_html() -> Column:
    """Source text of an element, exactly as written in the page."""
    return node_text("source")


def class_tokens(attrs: Column) -> Column:
    value = attrs["class"]
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(value, " ")
    )


def classes() -> Column:
    """Class tokens of a node row, empty where it has none."""
    return class_tokens(F.col("attrs"))
