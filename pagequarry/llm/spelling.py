"""Spelling variants by dynamic programming over sorted word lists.

Words are runs of letters; with a hash rule of the contract some occurrences lose a letter. Two words are near
if one insertion, deletion or replacement of a code point makes one the other. A word's form is its most
frequent near word, if that is `ratio` times as frequent; its root is where forms lead.

The vocabulary is dealt into blocks so that every near pair meets in exactly one. Of a pair whose shorter word
has m letters either the first m // 2 or the last m - m // 2 agree. So a word of length m joins, in class m and in
class m - 1 (as the longer one), the block of its first and the block of its last half. Blocks of more words than
`most` are split the same way in the part that is still open, until one letter is left; a pair belongs to the
block that its first difference names. No task gets more than blocks of that size, and no pair list is formed.

In a block the open parts are sorted and scanned once for each word: the rows of the edit matrix, three cells
wide, are kept by depth and reused up to the prefix that a word shares with the one before; where a row has no
cell of one or less, all words with that prefix are skipped.

Defined results: a null text has no words; a null doc_id counts as empty text in the hash; repeated rows count
each; ties of frequency go to the smallest word in code-point order; texts of any length are read by Spark's own
functions; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.sources.storage import cut

#: Letters of a run, and the rule that deletes one.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
DELETES = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
#: Words of a block above which it is split.
MOST_WORDS = 4096

_FAR = 2


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"),
    )
    # One row for each different run of a length that may count.
    runs = runs.where(F.length("run") >= letters)
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % DELETES == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= least) & (F.length("word") >= letters))


def _blocks(rows: DataFrame) -> DataFrame:
    """Names of blocks: class, letters given at the front and at the back, and these letters."""
    front = F.substr("word", F.lit(1), F.col("front"))
    back = F.substr("word", F.length("word") - F.col("back") + 1, F.col("back"))
    return rows.withColumns({"head": front, "tail": back})


def deal(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, class, front, back, until, head, tail): each word in the blocks where its near words can be.

    A pair belongs to a block if its first difference lies from `front` up to, not including, `until`.
    """
    size = F.length("word")
    rows = words.withColumn("class", F.explode(F.array(size, size - 1)))
    half = F.floor(F.col("class") / 2).cast("int")
    ends = F.array(
        F.struct(half.alias("front"), F.lit(0).alias("back"), F.lit(1 << 30).alias("until")),
        F.struct(F.lit(0).alias("front"), (F.col("class") - half).alias("back"), half.alias("until")),
    )
    open_ = _blocks(rows.withColumn("e", F.explode(ends)).select("word", "n", "class", "e.*"))
    done = []
    key = ["class", "front", "back", "until", "head", "tail"]
    for _ in range(24):
        open_ = cut(open_, "spelling-blocks")
        sizes = open_.groupBy(*key).agg(F.count(F.lit(1)).alias("words"))
        large = sizes.where((F.col("words") > most) & (F.col("class") - F.col("front") - F.col("back") > 1)).select(*key)
        large = cut(large, "spelling-large")
        if large.isEmpty():
            break
        done.append(open_.join(large, key, "left_anti"))
        half = F.floor((F.col("class") - F.col("front") - F.col("back")) / 2).cast("int")
        both = F.array(
            F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), F.col("until").alias("until")),
            F.struct(F.col("front").alias("front"), (F.col("class") - F.col("front") - half).alias("back"), (F.col("front") + half).alias("until")),
        )
        split = open_.join(large, key, "left_semi").select("word", "n", "class", F.explode(both).alias("e"))
        open_ = _blocks(split.select("word", "n", "class", "e.*"))
    for rows in done:
        open_ = open_.unionByName(rows)
    return open_


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def scan(query: str, words: list[str], prefixes: list[int]) -> Iterator[int]:
    """Positions of the words at a distance of exactly one from the query.

    `words` are sorted and different, `prefixes` the letters each shares with the one before. Row d of the matrix holds the
    distances of a word's first d letters to the query's first d - 1, d and d + 1.
    """
    m = len(query)
    rows = [(_FAR, 0, 1 if m else _FAR)]
    i, keep, count = 0, 0, len(words)
    while i < count:
        word = words[i]
        del rows[keep + 1 :]
        depth, dead = keep, False
        while depth < len(word) and not dead:
            letter = word[depth]
            low, same, high = rows[depth]
            depth += 1
            cells = []
            for j, replaced, inserted in ((depth - 1, low, same), (depth, same, high), (depth + 1, high, _FAR)):
                if j < 0 or j > m:
                    cells.append(_FAR)
                    continue
                best = inserted + 1
                if j > 0:
                    best = min(best, replaced + (query[j - 1] != letter), (cells[-1] + 1) if cells else _FAR)
                cells.append(min(best, _FAR))
            rows.append(tuple(cells))
            dead = min(cells) > 1
        if dead:
            # The words that share these letters stand together: none of them is near.
            past = bisect_left(words, word[:depth] + "\U0010ffff", i + 1)
            keep = min(depth - 1, _shared(word, words[past])) if past < count else 0
            i = past
            continue
        if abs(len(word) - m) <= 1 and rows[len(word)][m - len(word) + 1] == 1:
            yield i
        i += 1
        keep = prefixes[i] if i < count else 0


def block_pairs(size: int, front: int, back: int, until: int, members: list[tuple[str, int]]) -> Iterator[tuple]:
    """Near pairs (word, n, near, n of near), both ways, that belong to a block."""
    cuts = sorted((w[front : len(w) - back], w, n) for w, n in members)
    opens = [c[0] for c in cuts]
    prefixes = [0, *(_shared(a, b) for a, b in zip(opens, opens[1:]))]
    for open_, word, n in cuts:
        if len(word) != size:
            continue
        for i in scan(open_, opens, prefixes):
            _, other, m = cuts[i]
            if (len(other) > size or word < other) and front + _shared(open_, opens[i]) < until:
                yield word, n, other, m
                yield other, m, word, n


def near_pairs(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, near, near_n): every near pair once from either side."""
    key = ["class", "front", "back", "until", "head", "tail"]
    rows = deal(words, most)
    rows = rows.repartition(*key).sortWithinPartitions(*key).select(*key, "word", "n")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n", "near", "near_n"]
        kinds = [pa.string(), pa.int64()] * 2
        block, members, found = None, [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

        for batch in batches:
            for *name, word, n in zip(*(batch.column(c).to_pylist() for c in (*key, "word", "n"))):
                if name != block:
                    if len(members) > 1:
                        found.extend(block_pairs(*block[:4], members))
                    block, members = name, []
                    if len(found) > 50_000:
                        yield out()
                        found.clear()
                members.append((word, n))
        if len(members) > 1:
            found.extend(block_pairs(*block[:4], members))
        if found:
            yield out()

    return rows.mapInArrow(find, "word string, n long, near string, near_n long")


def forms(words: DataFrame, ratio: int = RATIO, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    pairs = near_pairs(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(pairs, "word", "left")
    found = -F.col("best.minus") >= ratio * F.col("n")
    return rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(found, F.col("best.near")).alias("form"),
        F.when(found, -F.col("best.minus")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """Rows with `root`. Frequencies grow along forms by the ratio, so chains are short; each round doubles the step."""
    steps = found.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        steps = cut(steps, "spelling-roots")
        ahead = steps.where(F.col("root") != F.col("word")).select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(ahead, "root", "left")
        if moved.where(F.col("next").isNotNull()).isEmpty():
            break
        steps = moved.select("word", F.coalesce("next", "root").alias("root"))
    return found.join(steps, "word")


def variants(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO, most: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of docs."""
    words = cut(vocabulary(docs, letters, least), "spelling-words")
    found = cut(forms(words, ratio, most), "spelling-forms")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
