"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A document leaks an item if a window of as many words as the item has a weighted similarity of 0.8 or
more to it: the sum of least counts over the sum of largest counts of their five-word shingles.

1. Gate. Such a window holds at least 0.8 of the item's number of shingles as shingles of the item, and may
   be taken to begin at one (moving it to its first common shingle never lowers the similarity). So
   windows are laid only there; no window that could reach the threshold is left out. A bit table
   of fixed size, made from all items, finds the documents worth a look without moving their texts.
2. Every distinct window and every item gets a 64-bit SimHash over its weighted shingles. Fingerprints are
   cut into `radius` + 1 blocks; two fingerprints within the radius agree in one block at least,
   so a join on (length, block, value) finds all pairs within the radius.
3. Pairs within the radius are verified by the exact weighted similarity.

Equal windows are searched once, so a passage that a third of all documents hold is one window; no join pairs
documents with each other.

Defined results: words are lower-case runs of non-blanks; items or documents under five words have no
shingles and never match; null texts count as empty; repeated rows (equal id and text) give
one row per item; a null doc_id or item_id is kept as a key; only the columns named are read. An empty table or benchmark
gives no rows; a text's shingles are one array, whatever its length; of equally similar windows the first is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.native import literal, shingles, where
from pagequarry.sources.storage import cut

SIMILARITY = 0.8
#: Bits in which the fingerprints of a window and an item may differ. At a similarity of 0.8 they differ
#: in 9.7 of 64 on average, with a deviation of 2.9.
RADIUS = 21
#: Bits of the gate, whatever the benchmark; it is only a filter before the exact join.
GATE_BITS = 1 << 20


def item_shingles(items: DataFrame) -> DataFrame:
    """item, sh (its shingles), n (their number) of the distinct items."""
    rows = items.select(F.col("item_id").alias("item"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    return shingles(rows, F.col("t"), "sh").select("item", "sh", F.size("sh").alias("n")).where("n > 0").distinct()


def gate_table(sh: DataFrame, bits: int = GATE_BITS) -> list[int]:
    """A bit table of the shingles as longs: bits / 64 numbers at most, however many shingles there are."""
    at = F.pmod(F.col("h"), F.lit(bits))
    rows = sh.select(F.explode("sh").alias("h")).select((at / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 AS int))").alias("b"))
    table = [0] * (bits // 64)
    for row in rows.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        table[row.w] = row.b
    return table


def gated(docs: DataFrame, table: list[int], least: int, widest: int) -> DataFrame:
    """doc_id, key, sh, at (positions that pass the table) of documents with `least` of them within `widest`."""
    bits = len(table) * 64
    rows = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    rows = shingles(rows, F.col("t"), "sh")
    gate = literal(table, "bigint")
    passes = F.filter(
        F.transform("sh", lambda h, i: F.struct(i.alias("p"), F.pmod(h, F.lit(bits)).alias("g"))),
        lambda x: F.get(gate, (x["g"] / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (x["g"] % 64).cast("int"))) != 0,
    )
    rows = rows.withColumn("at", F.transform(passes, lambda x: x["p"]))
    # The last of `least` positions lies within the widest window from the first of them.
    ends = F.slice("at", F.lit(least), F.greatest(F.size("at") - (least - 1), F.lit(0)))
    close = F.exists(F.zip_with(ends, F.slice("at", F.lit(1), F.size(ends)), lambda b, a: b - a < widest), lambda x: x)
    rows = rows.withColumn("close", F.when(F.size("at") >= least, close).otherwise(F.lit(False)))
    return where(rows, F.col("close")).select("doc_id", F.xxhash64("t", F.length("t")).alias("key"), "sh", "at")


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, key, n, start, body (its shingles): windows as long as an item that hold 0.8 of its number as its shingles."""
    ish = items.select("item", "n", F.explode(F.array_distinct("sh")).alias("h"))
    hits = docs.select("doc_id", "key", F.explode(F.transform("at", lambda p: F.struct(p.alias("p"), F.get("sh", p).alias("h")))).alias("x"))
    hits = hits.select("doc_id", "key", "x.p", "x.h").distinct().join(ish, "h")
    runs = hits.groupBy("doc_id", "key", "item", "n").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    least = F.ceil(F.col("n") * SIMILARITY).cast("int")
    runs = runs.withColumn("m", least).where(F.size("ps") >= F.col("m"))
    first = F.slice("ps", F.lit(1), F.size("ps") - F.col("m") + 1)
    last = F.slice("ps", F.col("m"), F.size("ps") - F.col("m") + 1)
    runs = runs.withColumn("fits", F.zip_with(first, last, lambda a, b: F.when(b - a < F.col("n"), a)))
    starts = runs.select("doc_id", "key", "n", F.explode(F.filter("fits", lambda a: a.isNotNull())).alias("start")).distinct()
    bodies = docs.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "sh").dropDuplicates(["d", "k"])
    rows = starts.join(bodies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    return rows.select("doc_id", "key", "n", "start", F.slice("sh", F.col("start") + 1, F.col("n")).alias("body"))


def simhash(sets: DataFrame, key: str, body: str) -> DataFrame:
    """key, fp: bit b of the fingerprint is set if more weight of the shingles has it set than not."""
    rows = sets.select(key, F.explode(body).alias("h"))
    sums = [F.sum(F.expr(f"2 * (shiftrightunsigned(h, {b}) & 1L) - 1")).alias(f"b{b}") for b in range(64)]
    rows = rows.groupBy(key).agg(*sums)
    bits = " | ".join(f"shiftleft(CAST(b{b} > 0 AS bigint), {b})" for b in range(64))
    return rows.select(key, F.expr(bits).alias("fp"))


def blocks(fps: DataFrame, radius: int) -> DataFrame:
    """One row per block of the fingerprint: 64 bits in radius + 1 blocks."""
    cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    parts = [F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L").alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return fps.select("*", F.inline(F.array(*parts)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, key, item_id, similarity (of the best window), start (its first word, the first of equal ones)."""
    items = cut(item_shingles(benchmark.select("item_id", "text")), "items")
    sizes = items.agg(F.min("n").alias("least"), F.max("n").alias("widest")).first()
    shortest, widest = sizes.least or 1, sizes.widest or 0
    least = max(1, -(-shortest * 8 // 10))
    docs = cut(gated(docs.select("doc_id", "text"), gate_table(items), least, widest), "gated")
    found = cut(windows(docs, items).withColumn("body_key", F.xxhash64("body", "n")), "windows")
    bodies = found.select("body_key", "n", "body").dropDuplicates(["body_key"])
    items = items.withColumn("item_key", F.xxhash64("sh", F.lit(0)))
    wanted = items.select("item_key", "n", "sh").dropDuplicates(["item_key"])
    left = bodies.select("body_key", "n").join(simhash(bodies, "body_key", "body"), "body_key")
    right = wanted.select("item_key", "n").join(simhash(wanted, "item_key", "sh"), "item_key").withColumnRenamed("fp", "item_fp")
    right = blocks(right.withColumnRenamed("item_fp", "fp"), radius).withColumnRenamed("fp", "item_fp")
    pairs = blocks(left, radius).join(right, ["n", "block", "value"])
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("body_key", "item_key").distinct()
    # Exact weighted similarity: 2 n - common in the union, for bodies and items with their own sizes.
    counted = bodies.select("body_key", F.size("body").alias("size"), F.explode("body").alias("h")).groupBy("body_key", "size", "h").agg(F.count("*").alias("c"))
    in_item = wanted.select("item_key", "n", F.explode("sh").alias("h")).groupBy("item_key", "n", "h").agg(F.count("*").alias("ic"))
    same = pairs.join(counted, "body_key").join(in_item, ["item_key", "h"])
    same = same.groupBy("body_key", "item_key", "size", "n").agg(F.sum(F.least("c", "ic")).alias("common"))
    same = same.withColumn("similarity", F.col("common") / (F.col("size") + F.col("n") - F.col("common"))).where(F.col("similarity") >= similarity)
    hits = found.select("doc_id", "key", "start", "body_key").join(same.select("body_key", "item_key", "similarity"), "body_key")
    hits = hits.join(items.select("item_key", F.col("item").alias("item_id")), "item_key")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    hits = hits.groupBy("doc_id", "key", "item_id").agg(best.alias("best"))
    return hits.select("doc_id", "key", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).cast("long").alias("start"))


def text_key(text: Column) -> Column:
    """The key of a document's text in `find_leaks`."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.xxhash64(low, F.length(low))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "start")


OP9_SQL = f"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) - 4 AS total, i AS p, array_to_string(w[i + 1:i + 5], ' ') AS h FROM dw, unnest(range(0, greatest(len(w) - 4, 0))) t(i)),
ish AS (SELECT item_id, len(w) - 4 AS n, array_to_string(w[i + 1:i + 5], ' ') AS h FROM iw, unnest(range(0, greatest(len(w) - 4, 0))) t(i)),
ic AS (SELECT item_id, n, h, count(*) AS c FROM ish GROUP BY ALL),
hits AS (SELECT DISTINCT doc_id, total, item_id, n, p FROM ds JOIN ic USING (h)),
wins AS (SELECT a.doc_id, a.item_id, a.n, a.p AS start, least(a.n, a.total - a.p) AS size, b.p AS p FROM hits a
  JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p >= a.p AND b.p < a.p + a.n),
counted AS (SELECT doc_id, item_id, n, start, size, h, count(*) AS c FROM wins JOIN ds USING (doc_id, p) GROUP BY ALL),
common AS (SELECT doc_id, item_id, n, start, size, sum(least(counted.c, ic.c)) AS common FROM counted JOIN ic USING (item_id, n, h) GROUP BY ALL),
scored AS (SELECT *, common / (size + n - common) AS similarity FROM common)
SELECT doc_id, item_id, round(max(similarity), 9) AS similarity, CAST(arg_min(start, (-similarity, start)) AS BIGINT) AS start
FROM scored WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id
"""
