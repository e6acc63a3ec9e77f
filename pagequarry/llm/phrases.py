"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. Words are counted from the first step on. A
longer phrase is activated as soon as both its parts (all words but the last, all but the first) have
reached the threshold, in the middle of a cycle, and is counted from the next step on (not before its parts are counted
themselves), until it has reached the threshold itself or one whole cycle is complete, when every shard has been scanned for it once. So
lengths interleave, and counting ends one cycle after the last part has reached the threshold.

A text is split into words once: a stored row is a block of text (4 MB, cut between pieces) of one lang and shard, as its different
words and the place of each word among them.

In the cycle a phrase is a hash of 54 bits, with its length and the step in which it was activated. A scan sums the keys of some
millions of phrases, sorts them and deals them into buckets by their highest bits: a row is one bucket's keys and counts
as bytes, so Spark shuffles few rows, and a bucket's rows are summed as arrays by one task. The number of buckets grows with the words.
What the scans need to know is in which step a part
has reached the threshold. This is a table of a fixed number of slots, one byte each: the
hash names the slot, a slot keeps the first step in which any of its phrases reached the threshold. The scans get it as `Slots`, a
bit for each slot and a byte for each one reached, since every Python worker holds its own. When a
phrase is activated follows from the slots alone, so every step agrees on it. Phrases that share a hash or a slot
can only be activated too early or without need, which costs time; none is missed.

A last scan counts, by their words, the phrases whose slots have reached the threshold. These counts are exact, and
so are all figures made from them. They are dealt into buckets in the same way, with the phrases as lines.

Phrases are summed for some blocks of a task, then by phrase: a frequent phrase is one of a bucket's entries for each sum, so none is hot.

Defined results: a null text has no words, a null lang is `und`; repeated rows count each; an empty table
gives no rows; texts of any length are cut between pieces, and only a single piece is held whole; equal scores and
counts are ordered by the phrase. Only `lang` and `text` are read, other columns of any name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.llm.near_dedup import mix
from pagequarry.sources.storage import cut


SHARDS = 3
THRESHOLD = 10
LONGEST = 3
#: A candidate falls to a longer one that holds this share (percent) of its occurrences.
COVERED = 50
TOP = 2000
BLOCK_BYTES = 4 << 20
#: Blocks of text that a task holds before it has read a whole one, in all.
WAITING_BLOCKS = 16
#: Keys of a task, or different phrases, that are summed before they are dealt out.
SUMMED_KEYS, SUMMED_PHRASES = 4 << 20, 1 << 20
#: Words of a shard to a bucket, and the powers of two between which the number of buckets lies.
BUCKET_WORDS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 19, 4, 13
#: Rows are large here: few of them make a row group, which a reader holds whole.
FEW_ROWS = {"parquet.block.row.count.limit": "8"}
#: Slots of a length's table: 64 for each phrase that reached the threshold in the length's first step, between these powers of two.
SLOTS_EACH, LEAST_SLOTS, MOST_SLOTS = 64, 16, 26
#: Low bits of a counted key: the step of activation and the length.
STEP_BITS, SIZE_BITS = 6, 4
#: Slot value of what has not reached the threshold.
NEVER = 255

_U = np.uint64
#: Lower-cases A-Z, makes every separator of pieces a line feed and every blank a space.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")

def pieces(text: bytes, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in blocks of about `limit` bytes, cut at ends of pieces."""
    at = 0
    while len(text) - at > limit:
        end = text.find(b"\n", at + limit)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


class Slots:
    """A table of slots in about a fifth of its bytes where few are reached: a bit for each, and the steps of those reached in
    order, found by the number of reached slots before each 64 of them. Read like the table itself, by an array of slots."""

    def __init__(self, table: np.ndarray):
        reached = table != NEVER
        self.size = len(table)
        self.bits = np.packbits(np.append(reached, np.zeros(-self.size % 64, bool)), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)[:-1]]).astype(np.uint32)
        self.steps = table[reached]

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        out = np.full(len(slots), NEVER, np.uint8)
        bit = (slots & 63).astype(_U)
        word = self.bits[slots >> 6] >> bit
        hit = np.flatnonzero(word & _U(1))
        # Of 64 slots those from the hit on are shifted to the low end: the others stand before it.
        at = slots[hit] >> 6
        earlier = np.bitwise_count(self.bits[at]) - np.bitwise_count(word[hit])
        out[hit] = self.steps[self.before[at] + earlier]
        return out


def encoded(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The different words of a text, and for each word its place among them from 1 on, with 0 between pieces."""
    spaced = pa.array([text.replace(b"\n", b" \n ").decode("utf-8", "replace")], pa.large_string())
    tokens = pc.split_pattern(spaced, " ").values.dictionary_encode()
    names, codes = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False)
    is_word = pc.invert(pc.is_in(names, pa.array(["", "\n"], pa.large_string()))).to_numpy(zero_copy_only=False)
    number = np.where(is_word, np.cumsum(is_word), 0)
    empty = pc.index(names, pa.scalar("", pa.large_string())).as_py()
    codes = number[codes[codes != empty]]
    again = np.concatenate([[False], (codes[1:] == 0) & (codes[:-1] == 0)]) if len(codes) else np.zeros(0, bool)
    return names.filter(pa.array(is_word)), codes[~again]


def _kind(words: int) -> type:
    return np.uint16 if words < 1 << 16 else np.uint32


class Block:
    """The phrases of a block: at each word, the phrase of every length that starts there."""

    def __init__(self, lang: str, codes: np.ndarray, hashes: np.ndarray, words: pa.Array | None = None):
        self.lang, self.hashes, self.words = lang, hashes, words
        self.codes = codes.astype(np.int64) - 1
        self.at = np.flatnonzero(self.codes >= 0)

    def lengths(self, longest: int, tables: list[Slots]) -> Iterator[tuple]:
        """Per length (size, at, opened, reached, hashes): the words where an active phrase starts, since which step it is active,
        in which step it reached the threshold, and its hash."""
        at, number = self.at, self.codes[self.at]
        here, opened = self.hashes[number], np.zeros(len(at), np.uint8)
        for size in range(1, longest + 1):
            if len(tables) < size:
                yield size, at, opened, np.full(len(at), NEVER, np.uint8), here
                return
            table = tables[size - 1]
            # Words are looked up once each.
            asked = self.hashes if size == 1 else here
            reached = table[(asked >> _U(65 - len(table).bit_length())).astype(np.int64)]
            reached = reached[number] if size == 1 else reached
            yield size, at, opened, reached, here
            # A longer phrase is active where two of this length that reached the threshold stand one word apart.
            live = np.flatnonzero(reached < NEVER)
            live = live[np.concatenate([at[live][1:] == at[live][:-1] + 1, [False]])] if len(live) else live
            if size == longest or not len(live):
                return
            # Its parts' slots may have been reached by others before the parts could be seen: it is not seen before them.
            opened = np.maximum.reduce([reached[live] + np.uint8(1), reached[live + 1] + np.uint8(1), opened[live], opened[live + 1]])
            at, here = at[live], here[live]
            here = mix(here * _U(0x9E3779B97F4A7C15) + self.hashes[self.codes[at + size]])

    def counted(self, step: int, shards: int, longest: int, tables: list[Slots]) -> Iterator[np.ndarray]:
        """Keys of the phrases that this step counts, one for each place."""
        low = _U((1 << STEP_BITS + SIZE_BITS) - 1)
        for size, _, opened, reached, here in self.lengths(longest, tables):
            now = np.flatnonzero((reached == NEVER) & (opened <= step) & (step < opened + np.int16(shards)))
            if len(now):
                yield here[now] & ~low | opened[now].astype(_U) << _U(SIZE_BITS) | _U(size)

    def named(self, longest: int, tables: list[Slots]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Text, hash and count of the phrases whose slot has reached the threshold, told apart by their words."""
        for size, at, _, reached, here in self.lengths(longest, tables):
            now = np.flatnonzero(reached < NEVER)
            if size == 1:
                n = np.bincount(self.codes[at[now]], minlength=len(self.hashes))
                some = np.flatnonzero(n)
                if len(some):
                    yield self.words.take(pa.array(some)), self.hashes[some], n[some]
            elif len(now):
                # Equal phrases have equal hashes; where others share one, a phrase comes in several runs, which are summed by their words.
                now = now[np.argsort(here[now])]
                differs = np.logical_or.reduce([np.diff(self.codes[at[now] + i]) != 0 for i in range(size)])
                starts = np.flatnonzero(np.concatenate([[True], differs]))
                yield self.text(at[now[starts]], size), here[now[starts]], np.diff(np.append(starts, len(now)))

    def text(self, at: np.ndarray, size: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.codes[at + i])) for i in range(size)]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def shard_table(docs: DataFrame, shards: int) -> DataFrame:
    """Blocks of every shard and lang: their different words as lines and their hashes as bytes, the codes of all words as bytes, how
    many words they have."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, str], list[bytes]] = {}
        sizes: dict[tuple[int, str], int] = {}

        def done(key: tuple[int, str]) -> Iterator[pa.RecordBatch]:
            words, codes = encoded(b"\n".join(waiting.pop(key)))
            del sizes[key]
            if len(words):
                names, seed = words.to_pylist(), zlib.crc32(key[1].encode())
                hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in names], _U)
                cells = [pa.array([x.tobytes()], pa.binary()) for x in (hashes, codes.astype(_kind(len(names))))]
                row = [pa.array([key[1]]), pa.array(["\n".join(names)]), *cells, pa.array([np.count_nonzero(codes)]), pa.array([key[0]], pa.int32())]
                yield pa.RecordBatch.from_arrays(row, ["lang", "words", "hashes", "codes", "n", "shard"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, text, shard in zip(batch.column("lang").to_pylist(), texts, batch.column("shard").to_pylist()):
                key = (shard, lang)
                for piece in pieces(text.as_py().translate(_PLAIN)):
                    waiting.setdefault(key, []).append(piece)
                    sizes[key] = sizes.get(key, 0) + len(piece) + 1
                    if sizes[key] >= BLOCK_BYTES:
                        yield from done(key)
                if sum(sizes.values()) >= WAITING_BLOCKS * BLOCK_BYTES:
                    yield from done(max(sizes, key=sizes.get))
        for key in list(waiting):
            yield from done(key)

    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
    )
    return rows.where(F.col("text").isNotNull()).mapInArrow(blocks, "lang string, words string, hashes binary, codes binary, n long, shard int")


def _scan(rows: DataFrame, tables: list[np.ndarray], schema: str, of, words: bool = False) -> DataFrame:
    """What `of(blocks, tables)` yields for a task's blocks: Arrow batches. Only `words` reads the words themselves."""
    shared = rows.sparkSession.sparkContext.broadcast([Slots(t) for t in tables])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            lines = batch.column("words") if words else [None] * batch.num_rows
            for lang, coded, hashed, names in zip(batch.column("lang").to_pylist(), batch.column("codes"), batch.column("hashes"), lines):
                hashes = np.frombuffer(hashed.as_buffer(), _U)
                codes = np.frombuffer(coded.as_buffer(), _kind(len(hashes)))
                named = pc.split_pattern(pa.array([names.as_py()], pa.large_string()), "\n").values if words else None
                yield Block(lang, codes, hashes, named)

    read = rows.select("lang", "codes", "hashes", *(["words"] if words else []))
    return read.mapInArrow(lambda batches: of(blocks(batches), shared.value), schema)


def _cells(data, ends: np.ndarray) -> pa.Array:
    """Bytes as one cell to each end (the first end is where they begin)."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _joined(cells: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(cell.as_buffer(), kind) for cell in cells])


def _bucket_ends(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted bucket numbers: the different ones, and where each begins, with the end."""
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return buckets[starts], np.append(starts, len(buckets))


def step_counts(rows: DataFrame, step: int, shards: int, longest: int, tables: list[np.ndarray], threshold: int, bits: int) -> DataFrame:
    """(bucket, keys, n) of the phrases that are active in this step; a count is at most the threshold."""
    kind = np.min_scalar_type(threshold)

    def summed(waiting: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(waiting), return_counts=True)
        buckets, ends = _bucket_ends((keys >> _U(64 - bits)).astype(np.int32))
        n = np.minimum(n, threshold).astype(kind)
        return pa.RecordBatch.from_arrays([pa.array(buckets), _cells(keys, 8 * ends), _cells(n, n.itemsize * ends)], ["bucket", "keys", "n"])

    def of(blocks: Iterator[Block], here: list[Slots]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for block in blocks:
            for keys in block.counted(step, shards, longest, here):
                waiting.append(keys)
                if sum(map(len, waiting)) >= SUMMED_KEYS:
                    yield summed(waiting)
                    waiting = []
        if waiting:
            yield summed(waiting)

    return _scan(rows, tables, "bucket int, keys binary, n binary", of)


def merged(counts: DataFrame, step: int, shards: int, longest: int, threshold: int) -> DataFrame:
    """A row a bucket: keys and counts of the phrases that the next step still counts, sorted keys of those that have reached the
    threshold, and how many of each length these are."""
    kind = np.min_scalar_type(threshold)

    def merge(rows: pa.Table) -> pa.Table:
        keys, n = _joined(rows["keys"], _U), _joined(rows["n"], kind)
        order = np.argsort(keys)
        keys, starts = _bucket_ends(keys[order])
        n = np.minimum(np.add.reduceat(n[order], starts[:-1], dtype=np.int64), threshold).astype(kind)
        opened = (keys >> _U(SIZE_BITS)).astype(np.int64) & (1 << STEP_BITS) - 1
        alive, reached = (n < threshold) & (opened + shards > step + 1), keys[n >= threshold]
        found = np.bincount((reached & _U((1 << SIZE_BITS) - 1)).astype(np.int64), minlength=longest + 1)
        cells = [pa.array([x.tobytes()], pa.binary()) for x in (keys[alive], n[alive], reached)]
        return pa.table([rows["bucket"][:1].combine_chunks(), *cells, pa.array([found.tolist()], pa.list_(pa.int64()))], ["bucket", "keys", "n", "reached", "found"])

    return counts.groupBy("bucket").applyInArrow(merge, "bucket int, keys binary, n binary, reached binary, found array<long>")


def named_counts(rows: DataFrame, longest: int, tables: list[np.ndarray], threshold: int, bits: int) -> DataFrame:
    """(lang, size, phrase, n) of the phrases with n >= threshold, all counted whose slots have reached it."""

    def summed(lang: str, waiting: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(waiting).group_by("phrase", use_threads=False).aggregate([("n", "sum"), ("bucket", "min")])
        bucket = rows["bucket_min"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        buckets, ends = _bucket_ends(bucket[order].astype(np.int32))
        end, none = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        lines = pc.binary_join_element_wise(rows["phrase"].take(pa.array(order)), end, none).combine_chunks()
        _, offsets, data = lines.buffers()
        offsets = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
        columns = [pa.array([lang]).take(pa.array(np.zeros(len(buckets), np.int32))), pa.array(buckets)]
        columns += [_cells(data, offsets[ends]), _cells(rows["n_sum"].to_numpy()[order], 8 * ends)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "lines", "n"])

    def of(blocks: Iterator[Block], here: list[Slots]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[pa.Table]] = {}
        for block in blocks:
            mine = waiting.setdefault(block.lang, [])
            for phrase, hashed, n in block.named(longest, here):
                bucket = (hashed >> _U(64 - bits)).astype(np.uint16)
                mine.append(pa.table([phrase, pa.array(n.astype(np.int64)), pa.array(bucket)], ["phrase", "n", "bucket"]))
            if mine and sum(t.num_rows for rows in waiting.values() for t in rows) >= SUMMED_PHRASES:
                yield summed(block.lang, waiting.pop(block.lang))
        for lang, mine in waiting.items():
            if mine:
                yield summed(lang, mine)

    def merge(rows: pa.Table) -> pa.Table:
        text = b"".join(cell.as_buffer().to_pybytes() for cell in rows["lines"])
        phrase = pc.split_pattern(pa.array([text[:-1].decode()], pa.large_string()), "\n").values
        counts = pa.table([phrase, pa.array(_joined(rows["n"], np.int64))], ["phrase", "n"]).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
        counts = counts.filter(pc.greater_equal(counts["n_sum"], threshold))
        phrase = counts["phrase"]
        lang = pa.array([rows["lang"][0].as_py()]).take(pa.array(np.zeros(len(phrase), np.int32)))
        return pa.table([lang, pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32()), phrase.cast(pa.string()), counts["n_sum"]], ["lang", "size", "phrase", "n"])

    dealt = _scan(rows, tables, "lang string, bucket int, lines binary, n binary", of, words=True)
    return dealt.groupBy("lang", "bucket").applyInArrow(merge, "lang string, size int, phrase string, n long")


def _noted(state: DataFrame, bits: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length, which of its 2 ** bits slots the phrases reached: a bucket's slots stand together and come packed."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("reached"):
                keys = np.frombuffer(cell.as_buffer(), _U)
                for size, wide in bits.items():
                    slots = (keys[keys & _U((1 << SIZE_BITS) - 1) == _U(size)] >> _U(64 - wide)).astype(np.int64)
                    if len(slots):
                        base = slots[0] >> 3
                        flags = np.zeros((slots[-1] >> 3) - base + 1 << 3, bool)
                        flags[slots - (base << 3)] = True
                        row = [pa.array([size], pa.int32()), pa.array([base]), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(row, ["size", "base", "flags"])

    out = {size: np.zeros(max(1, (1 << wide) >> 3), np.uint8) for size, wide in bits.items()}
    for row in state.select("reached").mapInArrow(pages, "size int, base long, flags binary").collect():
        flags = np.frombuffer(bytes(row.flags), np.uint8)
        out[row.size][row.base : row.base + len(flags)] |= flags
    return {size: np.unpackbits(flags, bitorder="little").astype(bool)[: 1 << bits[size]] for size, flags in out.items()}


def reached_tables(stored: DataFrame, threshold: int, longest: int, shards: int, buckets: int) -> list[np.ndarray]:
    """The table of each length: in which step a slot's phrases reached the threshold."""
    tables: list[np.ndarray] = []
    alive = None
    step, ends = 0, shards
    while step < ends:
        if step >= 1 << STEP_BITS:
            raise ValueError("too many steps: use fewer shards or shorter phrases")
        new = step_counts(stored.where(F.col("shard") == step % shards), step, shards, longest, tables, threshold, buckets)
        state = cut(merged(new if alive is None else new.unionByName(alive), step, shards, longest, threshold), "phrase-counts", **FEW_ROWS)
        found = state.select(F.posexplode("found").alias("size", "count")).groupBy("size").agg(F.sum("count").alias("count")).collect()
        found = {row["size"]: row["count"] for row in found if row["count"]}
        for size in sorted(found):
            if len(tables) < size:
                bits = max(LEAST_SLOTS, min(MOST_SLOTS, (SLOTS_EACH * found[size]).bit_length()))
                tables.append(np.full(1 << bits, NEVER, np.uint8))
        for size, slots in (_noted(state, {size: len(tables[size - 1]).bit_length() - 1 for size in sorted(found)}) if found else {}).items():
            table = tables[size - 1]
            slots &= table == NEVER
            if slots.any():
                table[slots] = step
                ends = max(ends, step + 1 + (shards if size < longest else 0))
        step += 1
        alive = state.where(F.length("keys") > 0).select("bucket", "keys", "n")
    return tables


def phrase_counts(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of every phrase of up to `longest` words with n >= threshold, and (lang, n) with all words."""
    stored = cut(shard_table(docs, shards), "phrase-shards", by=("shard",), **FEW_ROWS)
    words = stored.groupBy("lang").agg(F.sum("n").alias("n"))
    all_words = words.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, (all_words // shards // BUCKET_WORDS).bit_length()))
    tables = reached_tables(stored, threshold, longest, shards, buckets)
    return cut(named_counts(stored, longest, tables, threshold, buckets), "phrase-named"), words


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1,000,000 a a / (l r)) without rounding: whole division of decimals, for counts of up to 15 digits."""
    a, l, r = (x.cast("decimal(15,0)") for x in (a, l, r))  # noqa: E741
    top = (a * a).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, l * r)


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (two words or more) with the cut of the lowest score: lang, size, phrase, a, l, r, score.

    A part meets the different candidates that it starts or ends, not their occurrences; the side of the candidates may be
    split by Spark where one word has very many.
    """
    candidates = counts.where(F.col("size") > 1)
    words = F.split("phrase", " ")
    cuts = candidates.select(
        "lang", "size", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang", "size", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    best = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("b")
    return cuts.groupBy("lang", "size", "phrase", "a").agg(best).select("lang", "size", "phrase", "a", "b.l", "b.r", "b.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates without a longer one that holds them and at least `covered` percent of their occurrences."""
    words = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")),
        )
    )
    longer = candidates.where(F.col("size") > 2).select("lang", "a", words.alias("w"), "size")
    held = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(held, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, covered: int = COVERED, top: int | None = TOP
) -> DataFrame:
    """lang, rank, phrase, size, a, l, r, n, score of each lang's first `top` phrases (all for None), by score, then a, then phrase."""
    counts, words = phrase_counts(docs, threshold, longest, shards)
    kept = uncovered(cut(scored(counts), "phrase-scores"), covered)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "size", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = """
with texts as (
  select coalesce(lang, 'und') as lang, string_split(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
    'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' '), chr(10)) as pieces
  from documents where text is not null),
pieces as (select lang, list_filter(string_split(unnest(pieces), ' '), lambda v: v <> '') as w from texts),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces where len(w) > 0),
counts as (
  select lang, 1 as size, w[i] as phrase, count(*) as n from places group by all
  union all select lang, 2, w[i] || ' ' || w[i + 1], count(*) from places where i + 1 <= len(w) group by all
  union all select lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], count(*) from places where i + 2 <= len(w) group by all),
totals as (select lang, sum(n)::bigint as n from counts where size = 1 group by 1),
candidates as (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from counts where size > 1 and n >= 10),
cuts as (select *, unnest(range(1, size)) as k from candidates),
scores as (
  select c.lang, c.size, c.phrase, a, k, x.n as l, y.n as r, ((1000000::hugeint * a * a) // (x.n::hugeint * y.n))::bigint as score
  from cuts c
  join counts x on x.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ') and x.size = k
  join counts y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1:], ' ') and y.size = c.size - k),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (
  select lang, phrase, max(a) as longer from (
    select lang, a, w[1] || ' ' || w[2] as phrase from candidates where size = 3
    union all select lang, a, w[2] || ' ' || w[3] from candidates where size = 3) group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from best b left join held h on h.lang = b.lang and h.phrase = b.phrase
  where longer is null or 100 * longer < 50 * a)
select r.lang, rank, phrase, a, l, r.r, t.n, score from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""
