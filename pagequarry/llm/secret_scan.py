"""Secret scans: broad candidate patterns, and a random forest that removes false positives.

Candidates are unbroken runs of key-like characters with a digit or after `=`, and whatever is assigned to
a path with a credential's word in its name, or follows "Bearer". Features: length, character
transitions (runs of a class, changes between letters and digits, cases), shares of classes and of
distinct characters, coverage by dictionary words, the path a value is assigned to, and neighbouring
words. The forest is trained on labelled findings and then written as one column expression, so that
scanning is a projection: no text is moved.

Labelled findings are a table (value, left, right, label). `made_findings` gives a fixed number of them whose label is what
they were made as, so it does not follow from the features; the query and the pipeline learn from these. `labelled_findings`
instead takes them from a bounded sample of a corpus by a rule: values with a provider's prefix, assigned to a name with a
credential's word or following "Bearer" are true; candidates far from any such word, and the same places holding
placeholders, words, checksums or ids instead, are false. All others are undecided and not learned from.

Defined results: null or empty texts have no candidates; equal candidates of a text are findings each;
repeated rows (equal id and text) give one set of rows in `findings`, and are redacted each in
`redact`; with no true or no false finding to learn from every candidate is kept (score 1). An empty table gives no rows; a
text's candidates are one array, and their places a window that spills; `redact` carries all columns, and none of their names
clashes with its own. A score equal to the bound is kept.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.native import let, own, placed, where
from pagequarry.llm.secret_findings import made
from pagequarry.sources.storage import cut

#: A credential's word in the name of a path.
NAMED = r"(?=[a-dpstA-DPST])(?i:password|passwd|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|authorization|auth(?![a-z])|credential|private[_\-]?key|bearer)"
#: The rest of the name, what closes it, and the sign of assignment, with the scheme of a header. `==` and a blank end base64.
SIGN = r"""[\\"'\])]*+(?!==[ \t])[ \t]*+(?:=>|:=|={1,3}|:(?!:))[ \t]*+(?:(?i:bearer|basic|token)[ \t]++)?+"""
LEAD = rf"{NAMED}(?:(?!{NAMED})[A-Za-z0-9_.\-/\[\]])*+{SIGN}"
#: Up to the closing quote; without one up to a blank or quote, less closing punctuation and further `&name=`.
QUOTED = r"""(?:"(?:[^"\\\r\n]|\\.)++(?=")|'(?:[^'\\\r\n]|\\.)++(?=')|`[^`\r\n]++(?=`))"""
PLAIN = r"""(?=[^=\s])(?:[^\s"'`.,;:)\]}>&]|[.,;:)\]}>&]++(?![\s"'`]|$|(?<=[&,;])[A-Za-z0-9_.\-]++[=:]))++"""
#: Any value assigned to a credential's path, with the path's name before it, which is no part of the finding.
ASSIGNED = rf"{LEAD}(?:{QUOTED}|[\"'`]?+{PLAIN})"
BEARER = r"(?i:bearer)[ \t]++"
RUN = r"[A-Za-z0-9+/_\-]{12,}={0,2}(?![A-Za-z0-9+/_\-])"
#: A run with a digit that is not itself such a name, or any run after `=`.
CANDIDATE = rf"(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*+[0-9])(?![A-Za-z0-9+/_\-]*?{ASSIGNED})|(?<=[A-Za-z0-9_\-\])\"'=]=)){RUN}"
PATTERN = rf"{ASSIGNED}|(?<![A-Za-z]){BEARER}[A-Za-z0-9+/_.~\-]{{12,}}+=*|{CANDIDATE}"
#: The value of a match.
VALUE = rf"(?s)^(?:{LEAD}(?:[\"'`](?=.)|(?=[^=\s\"'`]))|{BEARER})?(.+)$"
#: A text without a digit, a sign of assignment and a bearer has no match.
CHEAP = r"[0-9=:]|(?i:bearer)"
#: Characters of context looked at on either side of a candidate.
CONTEXT = 60
#: Documents that findings are taken from for training, and findings of either label at most.
SAMPLE_DOCUMENTS = 20_000
MAX_FINDINGS = 4_000
TREES, DEPTH, SEED = 15, 5, 7
KEPT = 0.5
MASK = "[SECRET]"

CREDENTIAL = "password|passwd|pwd|secret|token|api_?key|apikey|access_?key|auth|credential|private_?key|bearer"
HARMLESS = "commit|sha1|sha256|md5|checksum|hash|digest|version|build|uuid|guid|order|invoice|phone|card|isbn|id"
PLACEHOLDER = "example|sample|dummy|changeme|placeholder|your|xxxx|test|12345|abcdef"
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-|AIza|ya29|eyJ"
WORDS = (
    "about account after again answer apple author before begin black board build center change check class color company contact country "
    "data date default describe document email enter error example field file first follow found general great group header hello home house "
    "image index input item language last learn letter level license light list little local login machine main match member message method "
    "model money month mother name never night number object order other output page paper part people person place point power present "
    "problem product program project public question read record release report result right sample school second section server service "
    "setting short small sound source start state story string study style system table target test text thing think time title tree type "
    "under update user value version water where which white window word work world write year your"
).split()
FEATURES = (
    "length", "runs", "letter_digit", "case_changes", "digits", "upper", "distinct", "vowels", "words", "has_path", "path_credential",
    "path_harmless", "path_depth", "near_credential", "near_harmless", "placeholder", "prefix", "hex_only", "digits_only", "quoted",
)


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def features(value: Column, left: Column, right: Column) -> Column:
    """struct of the features, as doubles."""
    assigned = rf"([A-Za-z0-9_.\-/\[\]]+){SIGN}[\"'`]?$"
    path = F.regexp_extract(left, assigned, 1)
    near = F.lower(F.concat_ws(" ", F.regexp_replace(left, assigned, ""), right))

    def has(text: Column, words: str) -> Column:
        return F.rlike(F.lower(text), F.lit(f"(?<![a-z])({words})(?![a-z])")).cast("double")

    letters = F.greatest(F.regexp_count(value, F.lit("[A-Za-z]")), F.lit(1))
    made = {
        "length": F.length(value),
        "runs": _share(value, r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"),
        "letter_digit": _share(value, r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),
        "case_changes": _share(value, r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "digits": _share(value, "[0-9]"),
        "upper": _share(value, "[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "vowels": F.regexp_count(value, F.lit("(?i)[aeiou]")) / letters,
        "words": 1 - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(WORDS, key=len, reverse=True)), "")) / F.length(value),
        "has_path": path != "",
        "path_credential": F.rlike(path, F.lit(f"{NAMED}(?![a-z])")),
        "path_harmless": has(path, HARMLESS),
        "path_depth": F.regexp_count(path, F.lit(r"[._/]")),
        "near_credential": has(near, CREDENTIAL),
        "near_harmless": has(near, HARMLESS),
        "placeholder": F.rlike(F.lower(value), F.lit(PLACEHOLDER)),
        "prefix": F.rlike(value, F.lit(f"^({PREFIXES})")),
        "hex_only": F.rlike(value, F.lit("^[0-9a-f]+$")),
        "digits_only": F.rlike(value, F.lit("^[0-9]+$")),
        "quoted": F.rlike(left, F.lit("[\"']$")),
    }
    return F.struct(*[made[f].cast("double").alias(f) for f in FEATURES])


def candidates(docs: DataFrame, p: str) -> DataFrame:
    """Every row with {p}raw (the matches), {p}hits (their values, none as null), {p}leads (the name before each value) and
    {p}gaps (the text between matches)."""
    # Most texts have no run with enough key-like characters; the cheap test spares them the rest.
    some = F.rlike("text", F.lit(CHEAP)) & F.rlike("text", F.lit(PATTERN))
    raw, hits = f"{p}raw", f"{p}hits"
    rows = docs.withColumn(raw, F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn(hits, F.transform(raw, lambda r: F.regexp_extract(r, VALUE, 1)))
    # The name before a value belongs to the text before it.
    rows = rows.withColumn(f"{p}leads", F.zip_with(raw, hits, lambda r, v: F.left(r, F.length(r) - F.length(v))))
    return rows.withColumn(f"{p}gaps", F.when(F.col(hits).isNotNull(), F.split("text", PATTERN))).drop(raw)


def _described(p: str) -> Column:
    """array of struct(value, left, right): the whole name and sign before the value, and CONTEXT characters on either side."""
    n = F.size(f"{p}hits")
    gaps = f"{p}gaps"
    lefts = F.zip_with(F.slice(gaps, F.lit(1), n), F.col(f"{p}leads"), lambda g, lead: F.concat(F.right(g, F.lit(CONTEXT)), lead))
    after = F.zip_with(F.slice(gaps, F.lit(2), n), F.slice(f"{p}leads", F.lit(2), n), lambda g, lead: F.left(F.concat(g, F.coalesce(lead, F.lit(""))), F.lit(CONTEXT)))
    return F.arrays_zip(F.col(f"{p}hits").alias("value"), lefts.alias("left"), after.alias("right"))


def decided(value: Column, left: Column, right: Column) -> Column:
    """1 for a secret, 0 for none, null where the rule cannot tell."""
    name = F.regexp_extract(left, rf"([A-Za-z0-9_.\-/\[\]]+){SIGN}[\"'`]?$", 1)
    named = F.rlike(name, F.lit(f"{NAMED}(?![a-z])")) & ~F.rlike(F.lower(name), F.lit(f"(?<![a-z])({HARMLESS})(?![a-z])"))
    # "password: required" and short values may be prose or settings.
    prose = F.rlike(value, F.lit("^[A-Za-z]?[a-z]*$")) & F.rlike(left, F.lit(r"\s$"))
    bearer = F.rlike(left, F.lit(rf"(?<![A-Za-z]){BEARER}$"))
    prefix = F.rlike(value, F.lit(f"^({PREFIXES})"))
    fake = F.rlike(F.lower(value), F.lit(PLACEHOLDER))
    true = prefix | ((named | bearer) & ~prose & (F.length(value) >= 8))
    near = F.rlike(F.concat_ws(" ", left, right), F.lit(NAMED))
    return F.when(fake, 0).when(true, 1).when(~near, 0)


def made_findings(spark: SparkSession) -> DataFrame:
    """A fixed number of findings, labelled as what they were made."""
    return spark.createDataFrame(made(WORDS), "value string, left string, right string, label int")


def _bounded(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """At most so many rows, the first by a hash. A share of the hashes is taken before rows are ordered, so that no task gets
    more than about twice the number."""
    total, share = rows.count(), 1 << 30
    if total > 2 * most:
        rows = where(rows, F.pmod(F.xxhash64(F.lit(7), *order), F.lit(share)) < int(share * 2 * most / total))
    return rows.orderBy(F.xxhash64(*order), *order).limit(most)


def labelled_findings(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, findings: int = MAX_FINDINGS) -> DataFrame:
    """value, left, right, label: at most so many findings of either label, from at most so many documents."""
    rows = where(candidates(docs.select("doc_id", "text"), "__"), F.col("__hits").isNotNull())
    rows = cut(rows.select("doc_id", F.xxhash64("text").alias("of"), _described("__").alias("found")), "candidates")
    rows = _bounded(rows, documents, "doc_id", "of").select(F.inline("found")).distinct()
    rows = cut(rows.withColumn("label", decided(F.col("value"), F.col("left"), F.col("right"))).where("label IS NOT NULL"), "labelled")
    true, false = (_bounded(rows.where(F.col("label") == i), findings, "value", "left", "right") for i in (1, 0))
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.pmod(F.xxhash64("value"), F.lit(len(WORDS))) + 1).cast("int"))
    kind = F.pmod(F.xxhash64("value", "right"), F.lit(4))
    decoy = (
        F.when(kind == 0, F.concat(F.lit("your_"), word, F.lit("_example_1")))
        .when(kind == 1, F.concat(word, word, F.lit("_"), word, F.lit("2024")))
        .when(kind == 2, F.repeat(F.right("value", F.lit(1)), 20))
        .otherwise(F.concat(F.lit("xxxxxxxxxxxx"), F.right("value", F.lit(4))))
    )
    sums = true.select(F.lower(F.sha1("value")).alias("value"), F.concat(F.lit("see "), word, F.lit(" commit ")).alias("left"), F.concat(F.lit(" in "), word).alias("right"), F.lit(0).alias("label"))
    decoys = true.select(decoy.alias("value"), "left", "right", F.lit(0).alias("label"))
    return true.unionByName(false).unionByName(decoys).unionByName(sums)


Forest = list  # of trees; a tree is a vote or (feature, bound, tree up to the bound, tree above)


def _trees(debug: str) -> Forest:
    """The trees from the forest's own description."""
    trees: list[list[str]] = []
    for line in debug.splitlines():
        text = line.strip()
        if re.match(r"Tree \d+", text):
            trees.append([])
        elif trees and text:
            trees[-1].append(text)

    def build(lines: list[str], at: int):
        if m := re.match(r"Predict: ([\d.]+)", lines[at]):
            return float(m[1]), at + 1
        m = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", lines[at])
        low, at = build(lines, at + 1)
        high, at = build(lines, at + 1)  # the line of the Else is skipped
        return (FEATURES[int(m[1])], float(m[2]), low, high), at

    return [build(t, 0)[0] for t in trees]


def votes(forest: Forest, f: Column) -> Column:
    """The share of trees that vote true, as an expression over the struct of features."""

    def node(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        name, bound, low, high = tree
        return node(low) if low == high else F.when(f[name] <= bound, node(low)).otherwise(node(high))

    return sum((node(t) for t in forest[1:]), node(forest[0])) / len(forest)


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """The forest; one tree that always votes true where there is nothing to learn from."""
    rows = findings.select(features(F.col("value"), F.col("left"), F.col("right")).alias("f"), F.col("label").cast("double").alias("label"))
    # In one partition and order, so that the bootstrap is the same however the findings were found.
    rows = rows.select("f.*", "label").coalesce(1).sortWithinPartitions(*FEATURES, "label")
    if len(rows.select("label").distinct().head(2)) < 2:
        return [1.0]
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return _trees(forest.fit(data).toDebugString)


def scanned(docs: DataFrame, model: Forest, p: str) -> DataFrame:
    """`candidates` with {p}found: array of struct(value, score) in the order of the text."""

    def scored(c: Column) -> Column:
        score = let(features(c["value"], c["left"], c["right"]), lambda f: votes(model, f))
        return F.struct(c["value"].alias("value"), score.alias("score"))

    found = F.when(F.col(f"{p}hits").isNotNull(), F.transform(_described(p), scored))
    rows = candidates(docs, p).withColumn(f"{p}found", found)
    # The text before a candidate, its name included.
    whole = F.zip_with(f"{p}gaps", f"{p}leads", lambda g, lead: F.concat(g, F.coalesce(lead, F.lit(""))))
    return rows.withColumn(f"{p}gaps", F.when(F.col(f"{p}hits").isNotNull(), whole)).drop(f"{p}leads")


def findings(docs: DataFrame, model: Forest) -> DataFrame:
    """doc_id, start, end, value, score, kept: every candidate of every document."""
    rows = where(scanned(docs.select("doc_id", "text"), model, "__"), F.col("__hits").isNotNull())
    rows = rows.select("doc_id", F.sha2("text", 256).alias("key"), "__gaps", "__hits", "__found").dropDuplicates(["doc_id", "key"])
    spans = placed(rows, ["doc_id", "key"], F.col("__gaps"), F.col("__hits"), F.transform("__found", lambda x: x["score"]))
    return spans.select("doc_id", "start", "end", F.col("hit").alias("value"), F.col("note").alias("score")).withColumn("kept", F.col("score") >= KEPT)


def redact(docs: DataFrame, model: Forest, mask: str = MASK) -> DataFrame:
    """The rows with kept findings replaced in their texts; other columns as they are."""
    columns, p = docs.columns, own(docs)
    rows = scanned(docs, model, p)
    parts = F.zip_with(f"{p}gaps", f"{p}found", lambda g, x: F.concat(g, F.when(x["score"] >= KEPT, mask).otherwise(F.coalesce(x["value"], F.lit("")))))
    text = F.when(F.col(f"{p}found").isNotNull(), F.array_join(parts, "")).otherwise(F.col("text"))
    return rows.withColumn(f"{p}text", text).select(*[F.col(f"{p}text").alias("text") if c == "text" else F.col(f"`{c}`") for c in columns])


def trained(spark: SparkSession) -> Forest:
    """The forest of the made findings: the same for every corpus, which is scanned once, with it."""
    return train(made_findings(spark))


def trained_on(docs: DataFrame) -> Forest:
    """The forest of a corpus's own findings, labelled by the rule."""
    return train(cut(labelled_findings(docs), "training"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = findings(docs, trained(spark))
    return rows.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "kept")
