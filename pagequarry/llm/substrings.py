"""Removal of repeated passages: seeds are winnowed anchors, matches are extended both ways.

A window is `window` consecutive words of one document. A word is removed if it lies in a window whose word
sequence also starts in a document with a smaller doc_id; windows are judged on the texts as given.

1. Anchors. Every run of 16 words has a hash; a window's anchor is its leftmost run of the smallest hash. Equal
   windows have equal anchors at equal places. Consecutive windows of one anchor are a `span`: the anchor
   extended both ways to the words that all its windows cover. There is about one span in 18 words.
2. Join. Anchors that stand in one document only are dropped. A span whose whole word sequence, by a fingerprint
   of 128 bits, also stands in a smaller document is matched as one.
3. Extension. Of the spans left, which are the first of their word sequence, those are looked at again whose
   anchor is shared: there two documents agree around the anchor and differ within its span. These spans are cut into
   their windows, and windows of equal words are matched. So a match reaches exactly as far as the words agree.
4. Matched windows of a document are joined into maximal repeats.

No pairs of documents are formed: a group of equal anchors, spans or windows only gives its smallest doc_id, by
partial aggregates. That goes back to the members by (fingerprint, salt), so a passage that very many
documents hold is spread over many tasks. A fingerprint stands for its words (two sums of 64 bits).

Defined results: a null or blank text has no words; a null doc_id counts as larger than all others, and two of
them do not repeat each other; rows of one doc_id do not repeat each other; repeated rows get equal results; ids may be of
any ordered type; texts of any length are hashed in slices of 1 MB and spans are cut every 2 ** 19 words; an empty
table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.llm.near_dedup import mix, word_hashes
from pagequarry.sources.storage import cut

WINDOW = 50
#: Words of an anchor; at most the window.
ANCHOR = 16
#: Tasks that the members of one group are dealt to.
SALTS = 61
SLICE_BYTES = 1 << 20
STEP_WORDS = 1 << 19

_U = np.uint64
#: Odd factors of the two rolling sums, and what tells their word values apart.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_KEY = ("doc_id", "of")


def slices(text: bytes) -> Iterator[bytes]:
    """A text in slices of about SLICE_BYTES, cut at blanks."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        blank = re.compile(rb"[\x20\x09-\x0D]").search(text, at + SLICE_BYTES)
        if blank is None:
            break
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:]


def hashes_of(text: bytes) -> np.ndarray:
    return np.concatenate([word_hashes([s])[0] for s in slices(text)])


class Sums:
    """Rolling sums of word hashes: the fingerprint of any run of words in constant time."""

    def __init__(self, words: np.ndarray):
        self.parts = []
        for i, factor in enumerate(_FACTORS):
            up = np.concatenate([np.ones(1, _U), np.cumprod(np.full(len(words), factor, _U), dtype=_U)])
            inverse = _U(pow(factor, -1, 1 << 64))
            down = np.concatenate([np.ones(1, _U), np.cumprod(np.full(len(words), inverse, _U), dtype=_U)])
            values = mix(words + _U(i))
            self.parts.append((np.concatenate([np.zeros(1, _U), np.cumsum(values * up[:-1], dtype=_U)]), down))

    def of(self, part: int, start: np.ndarray, size) -> np.ndarray:
        total, down = self.parts[part]
        return mix((total[start + size] - total[start]) * down[start] + np.asarray(size).astype(_U))


def spans(words: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end (`ends`: where each ends): start and number of windows of every span, and its
    anchor's hash and fingerprint."""
    n = len(words) - window + 1
    if n < 1:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, _U, _U, _U))
    sums, reach = Sums(words), window - anchor + 1
    seeds = sums.of(0, np.arange(len(words) - anchor + 1), anchor)
    at = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        view = np.lib.stride_tricks.sliding_window_view(seeds[lo : hi + reach - 1], reach)
        at[lo:hi] = np.arange(lo, hi) + view.argmin(axis=1)
    doc = np.searchsorted(ends, np.arange(n), "right")
    inside = np.arange(n) + window <= ends[doc]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    # A span ends before the next one or the first window that leaves the document.
    stops = np.flatnonzero(np.concatenate([new | ~inside, [True]]))
    count = stops[np.searchsorted(stops, start, "right")] - start
    size = count + window - 1
    return start, count, seeds[at[start]], sums.of(0, start, size), sums.of(1, start, size)


def _key(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text)


def find_spans(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, of, start, count, seed, one, two) of every span of every document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "count", "seed", "one", "two"]

        def out(batch, rows, firsts, found):
            start, count, *values = found
            row = np.searchsorted(firsts, start, "right") - 1
            taken = batch.select(list(_KEY)).take(pa.array(np.asarray(rows, np.int64)[row]))
            local = start - firsts[row]
            columns = [pa.array(local, pa.int64()), pa.array(count, pa.int32()), *[pa.array(v.view(np.int64)) for v in values]]
            return pa.RecordBatch.from_arrays([*taken.columns, *columns], [*_KEY, *names])

        for batch in batches:
            held, rows, sizes = [], [], []

            def done(batch=batch, held=held, rows=rows, sizes=sizes):
                ends = np.cumsum(sizes)
                found = out(batch, rows, ends - sizes, spans(np.concatenate(held), ends, window, anchor))
                held.clear(), rows.clear(), sizes.clear()
                return found

            for row, cell in enumerate(batch.column("text").cast(pa.binary())):
                words = hashes_of(cell.as_py()) if cell.is_valid else np.empty(0, _U)
                if len(words) < window:
                    continue
                if len(words) > STEP_WORDS:
                    # Slices of one long text, each with the words that its last windows reach into.
                    for lo in range(0, len(words) - window + 1, STEP_WORDS):
                        some = words[lo : lo + STEP_WORDS + window - 1]
                        start, *rest = spans(some, np.array([len(some)]), window, anchor)
                        yield out(batch, [row], np.array([0]), (start + lo, *rest))
                    continue
                held.append(words)
                rows.append(row)
                sizes.append(len(words))
                if sum(sizes) >= STEP_WORDS:
                    yield done()
            if held:
                yield done()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _key(F.col("text")).alias("of"), "text")
    return rows.mapInArrow(find, f"doc_id {kind}, of long, start long, count int, seed long, one long, two long")


def with_least(rows: DataFrame, keys: list[str], shared: bool = False) -> DataFrame:
    """Rows with `least`, the smallest doc_id of the rows of equal keys; with `shared` only those of keys that several doc_ids have.

    The group's result travels by (keys, salt) to as many tasks as the group has salts.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("salt", salt)
    groups = rows.groupBy(*keys).agg(
        F.min("doc_id").alias("least"),
        F.max("doc_id").alias("most"),
        F.bool_or(F.col("doc_id").isNull()).alias("unnamed"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("salts"),
    )
    several = (F.col("least") < F.col("most")) | (F.col("unnamed") & F.col("least").isNotNull())
    if shared:
        groups = groups.where(several)
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("salts"), i) == 1)
    groups = groups.select(*keys, "least", F.explode(held).alias("salt"))
    return rows.join(groups, [*keys, "salt"]).drop("salt")


def _repeats() -> Column:
    """Is the row's document one that comes after `least`?"""
    return F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("least") < F.col("doc_id")))


def cut_windows(docs: DataFrame, open_spans: DataFrame, window: int) -> DataFrame:
    """(doc_id, of, start, one, two) of every window of the spans given."""
    lists = open_spans.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "count"))).alias("spans"))
    rows = docs.select("doc_id", _key(F.col("text")).alias("of"), "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.of") == F.col("s.of"))
    rows = rows.join(lists.alias("s"), same).select("d.*", F.col("s.spans.start").alias("starts"), F.col("s.spans.count").alias("counts"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = hashes_of(batch.column("text")[row].cast(pa.binary()).as_py())
                starts = np.asarray(batch.column("starts")[row].as_py(), np.int64)
                counts = np.asarray(batch.column("counts")[row].as_py(), np.int64)
                sums = Sums(words)
                at = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                for lo in range(0, len(at), 1 << 16):
                    some = at[lo : lo + (1 << 16)]
                    taken = batch.select(list(_KEY)).take(pa.array(np.full(len(some), row)))
                    values = [pa.array(sums.of(i, some, window).view(np.int64)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(some), *values], [*_KEY, "start", "one", "two"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, of long, start long, one long, two long")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, of, start, end, least) of the maximal repeats: word positions whose windows all start in a smaller document,
    and the smallest doc_id among those. `of` is the xxhash64 of the text."""
    docs = docs.select("doc_id", "text")
    found = cut(find_spans(docs, window, min(anchor, window)), "spans")
    shared = cut(with_least(found, ["seed"], shared=True).drop("least"), "shared-spans")
    judged = cut(with_least(shared, ["one", "two"]), "judged-spans")
    whole = judged.where(_repeats()).select(*_KEY, "start", (F.col("start") + F.col("count") - 1 + window).alias("end"), "least")
    first = judged.where(~_repeats()).drop("least", "one", "two")
    again = with_least(first, ["seed"], shared=True).select(*_KEY, "start", "count")
    single = with_least(cut(cut_windows(docs, again, window), "windows"), ["one", "two"]).where(_repeats())
    single = single.select(*_KEY, "start", (F.col("start") + window).alias("end"), "least")
    order = Window.partitionBy(*_KEY).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = whole.unionByName(single).withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    ranges = ranges.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranges.groupBy(*_KEY, "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("least").alias("least")).drop("nth")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the other words joined by one space, of every row of docs."""
    lists = found.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    rows = docs.select("doc_id", _key(F.col("text")).alias("of"), "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.of") == F.col("r.of"))
    rows = rows.join(lists.alias("r"), same, "left")
    rows = rows.select("d.doc_id", "d.text", F.col("r.ranges.start").alias("starts"), F.col("r.ranges.end").alias("ends"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, ends = (batch.column(c) for c in ("text", "starts", "ends"))
            texts = texts.cast(pa.binary())
            first = 0
            kept, sizes, removed, held = [], [], [], 0

            def done():
                ids = batch.column("doc_id").slice(first, len(kept))
                text = pa.array(kept, pa.binary()).cast(pa.string())
                return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), text], ["doc_id", "n_words", "n_removed", "kept"])

            for row in range(batch.num_rows):
                words = _WORD.findall(texts[row].as_py() or b"")
                sizes.append(len(words))
                if starts[row].is_valid:
                    at, parts = 0, []
                    for lo, hi in zip(starts[row].as_py(), ends[row].as_py()):
                        parts += words[at:lo]
                        at = hi
                    words = parts + words[at:]
                removed.append(sizes[-1] - len(words))
                kept.append(b" ".join(words))
                held += len(kept[-1])
                if held >= 8 << 20:
                    yield done()
                    first, held = row + 1, 0
                    kept, sizes, removed = [], [], []
            if kept:
                yield done()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(strip, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = remove(docs, repeats(docs))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP12_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from words where len(w) >= 50)),
least as (select h, min(doc_id) as least from windows group by 1 having count(distinct doc_id) > 1),
starts as (select doc_id, p from windows join least using (h) where least < doc_id),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as q from starts),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) as q from words where len(w) > 0),
kept as (select doc_id, string_agg(w[q], ' ' order by q) as text, count(*) as n from places anti join gone using (doc_id, q) group by 1)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from words left join kept using (doc_id)
"""
