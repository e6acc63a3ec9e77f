"""Near-duplicates by DartMinHash signatures, banded joining and an exact check.

A text is its weighted set of five-word shingles (weight: how often it holds one; texts under five words
are one shingle). Two texts are linked if their weighted Jaccard similarity is 0.8 or more; a class is a
connected component of links.

1. Texts with equal words are one node, named by a digest of the words.
2. Signature (`darts`): every unit of an element's weight is a row of cells of area one; a hash throws
   Poisson(1) darts into each cell, with a rank and a coordinate. Of all darts under a text's weighted
   regions the earliest (lowest rank) of each coordinate is kept. About k ln k + 2 k darts are looked at
   per text, not k per element. Two texts agree in a coordinate with a probability equal to their similarity.
3. Banded joining: 32 bands of 6 coordinates. A pair at 0.8 shares a band with a probability of 0.99994.
4. Within a band's bucket the signatures' agreement estimates the similarity; links of a spanning forest
   of the pairs over 0.66 (4.5 deviations under 0.8) give coarse groups: connected components in Spark.
5. Within a coarse group all pairs are compared exactly through an index of shared shingles; a spanning
   forest of the links over 0.8 is kept, and its connected components are the classes.

Neither step 4 nor 5 writes all pairs of a group: a forest has fewer links than nodes, and no link
between classes is lost, since every pair of a bucket or group is compared. Large buckets and groups are
dealt into chunks, and every two chunks meet in a task of their own, of bounded size. Texts are shuffled
once, and only those in a coarse group.

Defined results: a null, empty or blank text is a class of its own; the class id is the smallest doc_id of the
class (null if it has none); repeated rows and rows with a null doc_id belong to the class of their
text; other columns are not read, whatever their names. An empty table gives no
rows. A text is hashed whole, in some 40 bytes for each of its own. Of equal smallest ids there is one class id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.llm.native import own, words
from pagequarry.sources.storage import cut

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Estimated similarity from which a pair is compared exactly.
ESTIMATE = 0.66
#: Members of a bucket's chunk; characters of a group's chunk.
CHUNK_MEMBERS = 2048
CHUNK_CHARS = 4_000_000
#: Bytes of text that are hashed at once.
STEP_BYTES = 1 << 21

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: Cumulative probabilities of Poisson(1), for the number of darts in a cell.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(cache.get("up", ())) < n:
        inverse = pow(int(_ODD), -1, 1 << 64)
        for name, base in (("up", int(_ODD)), ("down", inverse)):
            cache[name] = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, base, _U), dtype=_U)])
    return cache["up"], cache["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of its text, for texts as UTF-8. Words end at ASCII blanks."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.empty(0, _U), np.empty(0, np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    border = np.zeros(len(data) + 1, bool)
    border[np.cumsum(sizes)] = border[0] = True
    before = np.concatenate([[False], word[:-1]]) & ~border[:-1]
    after = np.concatenate([word[1:], [False]]) & ~border[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)])
    value = (total[end] - total[start]) * down[start]
    return mix(value + (end - start).astype(_U) * _ODD), np.searchsorted(np.cumsum(sizes), start, "right")


def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Units of the weighted shingle sets: hash of (shingle, which time it occurs) and the number of the text."""
    words, doc = word_hashes(texts)
    counts = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    width = np.minimum(SHINGLE, counts)
    shingle = np.zeros(len(words), _U)
    for i in range(SHINGLE):
        at = np.arange(len(words)) + i
        inside = i < width[doc]
        shingle = np.where(inside, mix(shingle * _ODD + words[np.minimum(at, len(words) - 1)] + _U(i)), shingle) if len(words) else shingle
    whole = np.arange(len(words)) + width[doc] <= first[doc] + counts[doc] if len(words) else np.empty(0, bool)
    shingle, doc = shingle[whole], doc[whole]
    order = np.lexsort((shingle, doc))
    s, d = shingle[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.arange(len(s))
    time = at - np.maximum.accumulate(np.where(new, at, 0)) if len(s) else at
    return mix(s + time.astype(_U) * _U(0xD6E8FEB86659FD93)), d


def darts(units: np.ndarray, doc: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """(n, k) signatures: the name of the earliest dart of every coordinate; zeros for texts without elements.

    units and doc are sorted by doc. A text of weight W is given darts up to the rank t / W, with t so that
    few coordinates stay empty; texts with an empty one are thrown again with twice the rank.
    """
    out = np.zeros((n, k), _U)
    weight = np.bincount(doc, minlength=n)
    rank = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    open_ = weight > 0
    while open_.any():
        own = open_[doc]
        u, d = units[own], doc[own]
        cells = np.ceil(rank[d]).astype(np.int64)
        which = np.repeat(np.arange(len(u)), cells)
        cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = mix(u[which] + (cell + 1).astype(_U) * _ODD)
        count = np.searchsorted(_POISSON, (seed >> _U(11)).astype(np.float64) / (1 << 53), "right")
        which, cell, seed = np.repeat(which, count), np.repeat(cell, count), np.repeat(seed, count)
        dart = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        name = mix(seed ^ mix((dart + 1).astype(_U)))
        time = cell + (mix(name) >> _U(11)).astype(np.float64) / (1 << 53)
        d = d[which]
        near = time < rank[d]
        name, time, d = name[near], time[near], d[near]
        slot = d * k + ((name >> _U(32)) % _U(k)).astype(np.int64)
        order = np.lexsort((name, time, slot))
        slot = slot[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        filled = np.zeros(n * k, bool)
        filled[slot[first]] = True
        done = open_ & filled.reshape(n, k).all(1)
        keep = done[slot[first] // k]
        out.reshape(-1)[slot[first][keep]] = name[order][first][keep]
        open_ &= ~done
        rank = rank * 2
    return out


def _steps(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of bounded size, with the place of the first."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t.as_py() or "").encode()
        if run and size + len(raw) > STEP_BYTES:
            yield at, run
            at, run, size = i, [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield at, run


def node_of(raw: bytes) -> str | None:
    """Digest of the words of a text; none for a text without words."""
    words = raw.split()  # bytes are split at the six ASCII blanks
    return hashlib.md5(b" ".join(words)).hexdigest() if words else None


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, chars, bands (a key per band), sig (a byte per coordinate) of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, run in _steps(batch.column("text")):
                units, doc = elements(run)
                sig = darts(units, doc, len(run))
                bands = np.zeros((len(run), BANDS), _U)
                for r in range(ROWS):
                    bands = mix(bands * _ODD + sig[:, r::ROWS] + _U(r))
                bands = mix(bands + np.arange(BANDS, dtype=_U))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(run)),
                        pa.array([node_of(t) for t in run], pa.string()),
                        pa.array([len(t) for t in run], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(run) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).reshape(-1))),
                        pa.array([s.tobytes() for s in (sig & _U(255)).astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "node", "chars", "bands", "sig"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"doc_id {kind}, node string, chars long, bands array<long>, sig binary")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of every `block`, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_pylist()
        at = 0
        for i in range(len(blocks)):
            if i and blocks[i] != blocks[i - 1]:
                held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, at = [], i
            elif not i and held and held[-1].column("block")[0].as_py() != blocks[0]:
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def dealt(rows: DataFrame, group: list[str], size, most: int, key: str) -> DataFrame:
    """Rows with `block`: groups over `most` in total are cut into chunks by a hash, and every pair of chunks is a block."""
    totals = rows.groupBy(*group).agg(F.sum(size).alias("total"), F.count("*").alias("members")).where("members > 1")
    totals = totals.select(*[F.col(g).alias(f"g_{g}") for g in group], F.ceil(F.col("total") / most).cast("int").alias("chunks"))
    on = [F.col(g) == F.col(f"g_{g}") for g in group]
    rows = rows.join(totals, on).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    rows = rows.withColumn("other", F.explode(others))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    rows = rows.withColumn("block", F.xxhash64(*group, low, high)).withColumn("side", F.when(F.col("chunk") == low, 0).otherwise(1))
    return rows


def coarse_links(nodes: DataFrame) -> DataFrame:
    """a, b: per bucket, a forest of the pairs whose signatures agree in ESTIMATE of the coordinates."""
    rows = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    rows = dealt(rows, ["band", "value"], F.lit(1), CHUNK_MEMBERS, "node").select("block", F.col("node").alias("n"))
    # Signatures are brought to the members of shared buckets only.
    rows = rows.join(nodes.select("node", "sig"), F.col("n") == F.col("node")).select("block", "node", "sig")
    rows = rows.repartition("block").sortWithinPartitions("block", "node")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out = [], []
        for table in _runs(batches):
            names = table.column("node").to_pylist()
            if len(names) < 2:
                continue
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(names), -1)
            lefts, rights = [], []
            for i in range(0, len(names), 256):
                for j in range(i, len(names), 256):
                    same = (sig[i : i + 256, None, :] == sig[None, j : j + 256, :]).mean(2) if len(names) > 2 else np.array([[1.0, (sig[0] == sig[-1]).mean()]])
                    x, y = np.nonzero(same >= ESTIMATE)
                    ordered = x + i < y + j
                    lefts.append(x[ordered] + i)
                    rights.append(y[ordered] + j)
            for x, y in forest(np.concatenate(lefts), np.concatenate(rights), len(names)):
                a_out.append(names[x])
                b_out.append(names[y])
            if len(a_out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a_out), pa.array(b_out)], ["a", "b"])
                a_out, b_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.string()), pa.array(b_out, pa.string())], ["a", "b"])

    return rows.mapInArrow(linked, "a string, b string").distinct()


def exact_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the texts with a weighted Jaccard similarity of SIMILARITY or more."""
    units, doc = elements(texts)
    sizes = np.bincount(doc, minlength=len(texts))
    values, at, counts = np.unique(units, return_inverse=True, return_counts=True)
    shared = counts[at] > 1
    at, doc = at[shared], doc[shared]
    order = np.argsort(at, kind="stable")
    holders, starts = doc[order], np.searchsorted(at[order], np.arange(len(values) + 1))
    by_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
    lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x in range(len(texts)):
        own = at[by_doc[x] : by_doc[x + 1]]
        if not len(own):
            continue
        size = starts[own + 1] - starts[own]
        index = np.arange(size.sum()) + np.repeat(starts[own] - (np.cumsum(size) - size), size)
        common = np.bincount(holders[index], minlength=len(texts))
        close = common >= SIMILARITY * (sizes[x] + sizes - common) - 1e-9
        y = np.flatnonzero(close[x + 1 :]) + x + 1
        lefts.append(np.full(len(y), x))
        rights.append(y)
    return np.concatenate(lefts), np.concatenate(rights)


def exact_links(members: DataFrame) -> DataFrame:
    """From node, chars, text, class: a, b, a forest of the links within every coarse group."""
    rows = dealt(members, ["class"], F.col("chars"), CHUNK_CHARS, "node").select("block", "node", "text")
    rows = rows.repartition("block").sortWithinPartitions("block", "node")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            names = table.column("node").to_pylist()
            pairs = forest(*exact_pairs([t.encode() for t in table.column("text").to_pylist()]), len(names))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in pairs]), pa.array([names[y] for _, y in pairs])], ["a", "b"])

    return rows.mapInArrow(linked, "a string, b string").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, class (smallest node) of the connected components, by alternating large and small stars.

    Each round is a grouping and a join of the links and is written to the shared folder; the number of
    rounds grows with the logarithm of the largest component.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        done = cut(small.select("e.*").where("u != v").distinct(), "stars")
        # Stars are done when every node has one link, and no centre has a link of its own.
        state = done.groupBy("u").agg(F.count("*").alias("n"))
        if not state.where("n > 1").head(1) and not done.join(state.select(F.col("u").alias("c")), F.col("v") == F.col("c")).head(1):
            break
        edges = done
    return done.select(F.col("u").alias("node"), F.col("v").alias("class")).union(done.select("v", "v").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class (null for a text without near-duplicate) of every row."""
    docs = docs.select("doc_id", "text")
    signed = cut(signatures(docs), "signatures")
    nodes = cut(signed.where("node IS NOT NULL").dropDuplicates(["node"]).select("node", "bands", "sig"), "nodes")
    groups = cut(components(coarse_links(nodes)), "groups")
    # One row of each node in a group brings the text; only these texts are shuffled.
    first = signed.join(groups, "node").groupBy("node", "class").agg(F.min("doc_id").alias("doc_id"), F.max("chars").alias("chars"))
    digest = F.md5(F.array_join(words(F.col("text")), " "))
    # Rows without an id are found by their digest, which is computed for them alone.
    docs = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), digest))
    first = first.select(F.coalesce(F.col("doc_id").cast("string"), "node").alias("key"), "node", "class", "chars")
    texts = docs.join(first, "key").where(digest == F.col("node"))
    texts = cut(texts.dropDuplicates(["node"]).select("node", "class", "chars", "text"), "members")
    found = components(exact_links(texts)).select(F.col("node").alias("n"), "class")
    return signed.select("doc_id", "node").join(found, F.col("node") == F.col("n"), "left").select("doc_id", "node", "class")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, node, class, class_id (smallest doc_id of the class), members (rows of the class) of every row."""
    rows = cut(classes(docs).withColumn("class", F.coalesce("class", "node")), "classes")
    some = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    rows = rows.join(some.withColumnRenamed("class", "c"), F.col("class") == F.col("c"), "left")
    alone = F.col("class").isNull()
    return rows.select("doc_id", "node", "class", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("members", F.lit(1)).cast("long").alias("members"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, of its smallest doc_id (of equal ids the smallest digest), with all columns.

    Texts without words are all kept, as each is a class of its own. Of rows with that id and equal words the one of the
    smallest hash of all columns stays.
    """
    rows = near_duplicates(docs).select("node", F.col("doc_id").alias("id"), "class_id", F.coalesce("class", "node").alias("class"))
    first = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
    columns, p = docs.columns, own(docs)
    key, node, row = f"{p}key", f"{p}node", f"{p}row"
    first = cut(first.select(F.coalesce(F.col("first.id").cast("string"), "first.node").alias(key), F.col("first.node").alias(node)), "first")
    digest = F.md5(F.array_join(words(F.col("text")), " "))
    # Ids decide which texts need a digest; rows without an id are keyed by it.
    empty = F.size(words(F.col("text"))) == 0
    keyed = docs.withColumn(key, F.when(empty, F.lit(None).cast("string")).otherwise(F.coalesce(F.col("doc_id").cast("string"), digest)))
    every = [F.col(f"`{c}`") for c in columns]
    # A key has one node: the rows stand together as the join left them, and are mostly one.
    equal = Window.partitionBy(key, node).orderBy(F.xxhash64(*every))
    real = keyed.join(first, key).where(digest == F.col(node)).withColumn(row, F.row_number().over(equal)).where(F.col(row) == 1).select(*every)
    blank = docs.where(F.coalesce(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "")) == "", F.lit(True)))
    return real.unionByName(blank)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id", "members", (F.col("doc_id") == F.col("class_id")).alias("kept"))
