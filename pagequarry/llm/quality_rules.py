"""Quality rules: surface counts and a log-likelihood ratio of hashed word n-grams.

The raw corpus and a trusted target each give a multinomial over hashed unigrams and bigrams. A
document's score is the mean over its n-grams of log p_target - log p_raw; documents under a fixed
threshold are rejected. Raw counts cover every document. The target is fitted on a bounded sample
of documents labelled good (`max_trusted`, the smallest by a hash of the id).

Defined results: a null or blank text has no words, score 0 and fails the base rule; without any
trusted document the two multinomials are equal and every score is 0; a null doc_id is never
trusted; repeated rows are counted and judged each; other columns are carried only by `judge`, and none of their
names clashes with its own. An empty table gives no rows. A text's words are one array, whatever its length. A score equal to the
threshold is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.native import hashes, literal, own, paired, where, words

#: N-grams fall into so many buckets, whatever the corpus.
BUCKETS = 16384
#: Labelled documents that the target is fitted on.
MAX_TRUSTED = 20_000
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.1
SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def _bucket(gram: Column, buckets: int) -> Column:
    if buckets & (buckets - 1) == 0:
        return gram.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")
    return F.pmod(gram, F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """log p_target - log p_raw of each bucket. `buckets` numbers reach the driver, however large the corpus."""
    ids = F.broadcast(trusted_ids(labels, max_trusted).select(F.col("doc_id").alias("__id"), F.lit(1).alias("__t")))
    rows = docs.select("doc_id", words(F.col("text")).alias("w")).join(ids, F.col("doc_id") == F.col("__id"), "left")
    # A row for each word with the next one, hashed as a row: no function is interpreted per array element.
    after = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    rows = rows.select("__t", F.inline(F.arrays_zip(F.col("w"), after.alias("next"))))
    rows = rows.select("__t", F.xxhash64("w").alias("h"), F.when(F.col("next").isNotNull(), F.xxhash64("next")).alias("n"))
    pair = F.when(F.col("n").isNotNull(), F.xxhash64("h", "n"))
    rows = rows.select("__t", F.explode(F.array(_bucket(F.col("h"), buckets), _bucket(pair, buckets))).alias("bucket")).where("bucket IS NOT NULL")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__t").alias("target")).collect()
    raw, target = [1.0] * buckets, [1.0] * buckets
    for row in counts:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if not any(row.target for row in counts):
        return [0.0] * buckets
    all_raw, all_target = math.fsum(raw), math.fsum(target)
    # A bucket that the target hardly saw is judged by the raw rate, with a weight of one.
    return [math.log((t - 1 + r / all_raw * buckets) / all_target) - math.log(r / all_raw) for r, t in zip(raw, target)]


def _repeated(order: str) -> Column:
    """Words covered by windows that occur twice: the union of [start, start + 8) over such starts."""
    return F.aggregate(
        F.col(order),
        F.struct(F.lit(-8).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(8), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, into: str = "judged") -> DataFrame:
    """Every row with its counts, `score`, `base_failed` and `kept` in one struct column, in place of one of that name."""
    carried, p = [c for c in docs.columns if c != into], own(docs)
    x, w, h, two, four, eight, z, e, f, at, lines, counts = (f"{p}{n}" for n in ("x", "w", "h", "2", "4", "8", "z", "e", "f", "s", "l", "c"))
    rows = docs.withColumn(x, F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn(w, words(F.col(x)))
    rows = rows.withColumn(h, hashes(F.col(w)))
    rows = rows.withColumn(two, paired(F.col(h), 1))
    rows = rows.withColumn(four, paired(F.col(two), 2))
    rows = rows.withColumn(eight, paired(F.col(four), 4))
    twice = F.size(F.array_distinct(eight)) < F.size(eight)
    rows = rows.withColumn(z, F.when(twice, F.array_sort(F.transform(eight, lambda v, i: F.struct(v.alias("h"), i.alias("p"))))))
    # A sorted window is repeated if its neighbour on either side is equal.
    same = F.zip_with(
        F.col(z), F.slice(z, F.lit(2), F.greatest(F.size(z) - 1, F.lit(0))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    )
    rows = rows.withColumn(e, F.when(F.col(z).isNotNull(), same))
    shifted = F.concat(F.array(F.lit(False)), F.col(e))
    rows = rows.withColumn(f, F.when(F.col(e).isNotNull(), F.zip_with(e, shifted, lambda a, b: F.coalesce(a, F.lit(False)) | b)))
    hit = F.zip_with(z, f, lambda v, g: F.when(g, v["p"]))
    rows = rows.withColumn(at, F.when(F.col(f).isNotNull(), F.array_sort(F.filter(hit, lambda v: v.isNotNull()))))
    filled = F.filter(F.split(x, "\n"), lambda s: F.translate(s, BLANK_CHARS, "") != "")
    rows = rows.withColumn(lines, F.when(F.contains(F.col(x), F.lit("\n")), filled))
    table, buckets = literal(ratios, "double"), len(ratios)

    def total(grams: str) -> Column:
        return F.aggregate(F.col(grams), F.lit(0.0), lambda a, g: a + F.get(table, _bucket(g, buckets)))

    n = F.size(w).cast("long")
    rows = rows.withColumn(
        counts,
        F.struct(
            n.alias("n_words"),
            F.length(F.translate(x, BLANK_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(x) - F.length(F.translate(x, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0)).cast("long").alias("n_dup_lines"),
            F.coalesce(F.when(F.col(at).isNotNull(), _repeated(at)), F.lit(0).cast("long")).alias("n_repeat_words"),
            F.when(n == 0, 0.0).otherwise((total(h) + total(two)) / F.greatest(2 * n - 1, F.lit(1))).alias("score"),
        ),
    )
    c = F.col(counts)
    failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    judged = F.struct(f"{counts}.*", failed.alias("base_failed"), (~failed & (c["score"] >= threshold)).alias("kept"))
    return rows.select(*[F.col(f"`{name}`") for name in carried], judged.alias(into))


def keep(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are kept, as they are."""
    verdict = f"{own(docs)}judged"
    judged = judge(docs, ratios, threshold, verdict)
    return where(judged, F.col(f"{verdict}.kept")).drop(verdict)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ratios = log_ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, ratios).select(
        "doc_id", *[f"judged.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")]
    )
