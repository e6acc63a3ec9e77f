"""License scans: ordered signature rules behind a keyword prefilter.

A text is reduced to its lower-case words. A rule is a regular expression over these words, with a
label, a priority and a keyword; it is tried only on texts that hold its keyword as a word. Of the
detections of a text, one that lies inside another of no lower priority is suppressed (of two on the same
words, the one with the higher priority, then the earlier rule, stays). Labels are those of the
detections left, and the base labels of four phrases, which always stay.

Defined results: a null or empty text has no words and no label; a phrase that stands twice counts twice;
repeated rows get equal results, since detections belong to a text's digest; other columns are not read. An empty table
gives no rows; texts of any length are matched whole; of detections with equal spans and priority the first rule stays.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.llm.native import placed, where

#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: label, keyword, names of the license as patterns over words, version pattern or None. Every text of every name
#: holds the keyword as a word, and one of COARSE.
FAMILIES = (
    ("gpl", "gnu", ("gnu general public licen[cs]e", "gnu gpl"), "[1-3](?: 0)?"),
    ("gpl", "gpl", ("gpl",), "v?[1-3](?: 0)?"),
    *(("gpl", k, (k,), "v?[1-3](?: 0)?") for k in ("gplv1", "gplv2", "gplv3", "gpl2", "gpl3")),
    ("lgpl", "gnu", ("gnu (?:lesser|library) general public licen[cs]e", "gnu lgpl"), "[23](?: [01])?"),
    ("lgpl", "lgpl", ("lgpl",), "v?[23](?: [01])?"),
    *(("lgpl", k, (k,), "v?[23](?: [01])?") for k in ("lgplv2", "lgplv3")),
    ("agpl", "affero", ("(?:gnu )?affero general public licen[cs]e",), "3(?: 0)?"),
    ("agpl", "agpl", ("agpl",), "v?3(?: 0)?"),
    ("agpl", "agplv3", ("agplv3",), "v?3(?: 0)?"),
    ("gfdl", "gnu", ("gnu free documentation licen[cs]e",), "1(?: [123])?"),
    ("apache", "apache", ("apache (?:software )?licen[cs]e",), "v?(?:1 [01]|2(?: 0)?)"),
    ("apache", "asl", ("asl",), "v?(?:1 [01]|2(?: 0)?)"),
    ("mit", "mit", ("mit licen[cs]e", "mit x11 licen[cs]e"), None),
    ("mit", "expat", ("expat licen[cs]e",), None),
    ("bsd-2-clause", "bsd", ("(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?",), None),
    ("bsd-2-clause", "freebsd", ("freebsd(?: licen[cs]e)?",), None),
    ("bsd-3-clause", "bsd", ("(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?",), None),
    ("bsd", "bsd", ("bsd(?: style)? licen[cs]e",), None),
    ("isc", "isc", ("isc licen[cs]e",), None),
    ("zlib", "zlib", ("zlib(?: libpng)? licen[cs]e",), None),
    ("mpl", "mozilla", ("mozilla public licen[cs]e",), "v?(?:1 [01]|2(?: 0)?)"),
    ("mpl", "mpl", ("mpl",), "v?(?:1 [01]|2(?: 0)?)"),
    ("epl", "eclipse", ("eclipse public licen[cs]e",), "v?[12](?: 0)?"),
    ("edl", "eclipse", ("eclipse distribution licen[cs]e",), "v?1(?: 0)?"),
    ("cddl", "cddl", ("cddl",), "v?1(?: [01])?"),
    ("cddl", "common", ("common development and distribution licen[cs]e",), "v?1(?: [01])?"),
    ("cpl", "common", ("common public licen[cs]e",), "v?1(?: 0)?"),
    ("artistic", "artistic", ("(?:perl )?artistic licen[cs]e",), "v?[12](?: 0)?"),
    ("boost", "boost", ("boost software licen[cs]e",), "v?1(?: 0)?"),
    ("unlicense", "unlicense", ("(?:the )?unlicense",), None),
    ("wtfpl", "wtfpl", ("wtfpl",), "v?[12]"),
    ("eupl", "eupl", ("eupl",), "v?1(?: [012])?"),
    ("eupl", "european", ("european union public licen[cs]e",), "v?1(?: [012])?"),
    ("odbl", "database", ("open database licen[cs]e",), "v?1(?: 0)?"),
    ("ofl", "sil", ("sil open font licen[cs]e",), "v?1(?: [01])?"),
    ("psf", "python", ("python (?:software foundation )?licen[cs]e",), "v?[23](?: [0-9])?"),
    ("php", "php", ("php licen[cs]e",), "v?3(?: 0 ?1?)?"),
    ("ms-pl", "microsoft", ("microsoft public licen[cs]e",), None),
    ("cc-by-nc-nd", "cc", ("cc by nc nd",), "[1-4] [05]"),
    ("cc-by-nc-sa", "cc", ("cc by nc sa",), "[1-4] [05]"),
    ("cc-by-nc", "cc", ("cc by nc",), "[1-4] [05]"),
    ("cc-by-nd", "cc", ("cc by nd",), "[1-4] [05]"),
    ("cc-by-sa", "cc", ("cc by sa",), "[1-4] [05]"),
    ("cc-by", "cc", ("cc by",), "[1-4] [05]"),
    ("cc0", "cc0", ("cc0",), "1(?: 0)?"),
    ("cc-by-nc-nd", "creative", ("creative commons attribution non ?commercial no ?deriv(?:ative)?s",), "[1-4] [05]"),
    ("cc-by-nc-sa", "creative", ("creative commons attribution non ?commercial share ?alike",), "[1-4] [05]"),
    ("cc-by-nc", "creative", ("creative commons attribution non ?commercial",), "[1-4] [05]"),
    ("cc-by-sa", "creative", ("creative commons attribution share ?alike",), "[1-4] [05]"),
    ("cc-by", "creative", ("creative commons attribution",), "[1-4] [05]"),
    ("cc0", "creative", ("creative commons zero",), "1(?: 0)?"),
    ("public-domain", "domain", ("(?:dedicated to |released into |in )the public domain",), None),
    ("proprietary", "rights", ("all rights reserved",), None),
    ("proprietary", "proprietary", ("proprietary and confidential",), None),
)
#: How a license is named, with priority and confidence. N stands for a name, V for a version.
FORMS = (
    ("spdx license identifier N(?: V)?(?: only| or later)?", 5, 1.0),
    ("licen[cs]ed under (?:the )?(?:terms of (?:the )?)?N(?: licen[cs]e)?(?: (?:version )?V)?(?: international)?(?: or later| or any later version)?", 4, 0.95),
    ("(?:under|by|with) (?:the )?(?:terms|conditions) (?:and conditions )?of (?:the )?N(?: (?:version )?V)?", 4, 0.9),
    ("(?:released|distributed|available|published) under (?:the )?N(?: (?:version )?V)?", 4, 0.9),
    ("(?:the )?N (?:version )?V", 3, 0.8),
    ("(?:the )?N", 2, 0.6),
)
#: Families whose short name says a license only in the first STRICT forms; "published under the MIT Press" says none.
SHORT = (
    ("apache", "apache", ("apache(?: software)?",), "v?(?:1 [01]|2(?: 0)?)"),
    ("mit", "mit", ("mit", "mit x11"), None),
    ("mit", "expat", ("expat",), None),
    ("bsd", "bsd", ("bsd(?: style)?",), None),
    ("isc", "isc", ("isc",), None),
    ("zlib", "zlib", ("zlib(?: libpng)?",), None),
    ("gfdl", "gfdl", ("gfdl",), "1(?: [123])?"),
    ("mpl", "mozilla", ("mozilla(?: public)?",), "v?(?:1 [01]|2(?: 0)?)"),
    ("epl", "epl", ("epl",), "v?[12](?: 0)?"),
    ("edl", "edl", ("edl",), "v?1(?: 0)?"),
    ("cpl", "cpl", ("cpl",), "v?1(?: 0)?"),
    ("artistic", "artistic", ("(?:perl )?artistic",), "v?[12](?: 0)?"),
    ("boost", "bsl", ("bsl",), "v?1(?: 0)?"),
    ("boost", "boost", ("boost(?: software)?",), "v?1(?: 0)?"),
    ("odbl", "odbl", ("odbl",), "v?1(?: 0)?"),
    ("ofl", "ofl", ("(?:sil )?ofl",), "v?1(?: [01])?"),
    ("psf", "psf", ("psf",), "v?2(?: 0)?"),
    ("psf", "python", ("python(?: software foundation)?",), "v?[23](?: [0-9])?"),
    ("php", "php", ("php",), "v?3(?: 0 ?1?)?"),
    ("ms-pl", "pl", ("ms pl",), None),
)
STRICT = 2
_SOURCE_AND_BINARY = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
#: Texts that grant a license without naming it: label, keyword, pattern, priority, confidence.
GRANTS = (
    (
        "mit",
        "granted",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:the software )?to deal in the software without restriction",
        4,
        0.9,
    ),
    ("bsd", "redistribution", _SOURCE_AND_BINARY, 4, 0.8),
    ("bsd-2-clause", "redistribution", _SOURCE_AND_BINARY + r" (?:(?s:.*?) )??materials provided with the distribution this software is provided", 4, 0.9),
    (
        "bsd-3-clause",
        "redistribution",
        _SOURCE_AND_BINARY
        + r" (?:(?s:.*?) )??materials provided with the distribution (?:3 |c |iii )?(?:neither the names? of|the names? of) (?s:.+?) may (?:not )?be used to endorse or promote products derived from this software",
        4,
        0.9,
    ),
    (
        "isc",
        "granted",
        "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        4,
        0.9,
    ),
    ("zlib", "granted", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 4, 0.9),
    ("boost", "granted", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this license", 4, 0.9),
    ("ofl", "granted", "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute", 4, 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 4, 0.9),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 4, 0.9),
)
#: What a text must hold to be tried at all; every match of a rule holds one of them.
COARSE = (
    " licen", " gnu ", " gpl", " cc", " creative ", " bsd ", " freebsd ", " apache ", " asl ", " mpl ", " cddl ", " eupl ", " unlicense ", " wtfpl ",
    " lgpl", " agpl", " domain ", " rights ", " proprietary ", " hereby granted ", " redistribution and use ", " granted to anyone ", " unencumbered ", " fuck ",
)
RULE_FIELDS = ("rule", "keyword", "regex", "label", "priority", "confidence")
RULES_SCHEMA = "array<struct<rule int, keyword string, regex string, label string, priority int, confidence double>>"


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """Every family in every form, short names in the strict ones, and the grants, in order; some 400 rules."""
    out = []
    for label, keyword, names, version, forms in [(*f, FORMS) for f in FAMILIES] + [(*f, FORMS[:STRICT]) for f in SHORT]:
        for name in names:
            for form, priority, confidence in forms:
                if "V" in form and version is None:
                    if "(?: V)?" not in form and "(?: (?:version )?V)?" not in form:
                        continue
                body = form.replace("(?: (?:version )?V)?", "" if version is None else f"(?: (?:version )?(?:{version}))?")
                body = body.replace("(?: V)?", "" if version is None else f"(?: (?:{version}))?")
                body = body.replace("V", f"(?:{version})").replace("N", f"(?:{name})")
                out.append((len(out), keyword, f"(?<= ){body}(?= )", label, priority, confidence))
    for label, keyword, body, priority, confidence in GRANTS:
        out.append((len(out), keyword, f"(?<= ){body}(?= )", label, priority, confidence))
    return out


def normal(text: Column) -> Column:
    """The words of a text, A-Z in lower case, each with a blank on either side of the run; a blank for none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _base(norm: Column, n_words: Column) -> Column:
    """struct(n, first, last, labels) of the base phrases."""
    # With every blank doubled, neighbouring phrases do not share one.
    apart = F.replace(norm, F.lit(" "), F.lit("  "))
    parts = []
    for phrase, label in BASE:
        one, two = f" {phrase} ", f" {phrase.replace(' ', '  ')} "
        n = ((F.length(apart) - F.length(F.replace(apart, F.lit(two), F.lit("")))) / len(two)).cast("long")
        first = _spaces(F.substring(norm, F.lit(1), F.locate(one, norm) - 1))
        back = F.reverse(norm)
        last = n_words - _spaces(F.substring(back, F.lit(1), F.locate(one[::-1], back) - 1)) - len(phrase.split())
        none = F.lit(None).cast("long")
        some = F.contains(norm, F.lit(one))
        parts.append(F.struct(F.when(some, n).otherwise(0).alias("n"), F.when(some, first).otherwise(none).alias("first"), F.when(some, last).otherwise(none).alias("last"), F.when(some, F.lit(label)).alias("label")))
    each = F.array(*parts)
    gate = F.contains(norm, F.lit(" license ")) | F.contains(norm, F.lit(" cc by "))
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("label"))
    return F.when(gate, each).otherwise(F.array(empty))


def detections(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """From key, norm: key, rule, label, confidence, start, end (characters of norm) of the detections left."""
    rows = json.dumps([dict(zip(RULE_FIELDS, r)) for r in rules()])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), RULES_SCHEMA)))
    keywords = sorted({r[1] for r in rules()})
    found = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("norm"), F.concat(F.lit(" "), k, F.lit(" "))))
    # The rules are a constant of this module, so their broadcast is bounded.
    pairs = texts.select("key", "norm", F.explode(found).alias("keyword")).join(F.broadcast(table), "keyword")
    pairs = pairs.where(F.rlike("norm", F.col("regex")))
    hits = placed(pairs, ["key", "rule", "label", "priority", "confidence"], F.split("norm", F.col("regex")), F.regexp_extract_all("norm", F.col("regex"), F.lit(0)))
    order = Window.partitionBy("key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({p for _, p, _ in FORMS})
    for p in levels:
        hits = hits.withColumn(f"until_{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order))
    inside = F.lit(False)
    for p in levels:
        inside = inside | ((F.col("priority") == p) & (F.col(f"until_{p}") >= F.col("end")))
    return hits.where(~F.coalesce(inside, F.lit(False))).select("key", "rule", "label", "confidence", "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, labels and score of every row; score is the highest confidence."""
    rows = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    rows = rows.withColumn("n_words", F.when(F.col("norm") == " ", 0).otherwise(_spaces(F.col("norm")) - 1).cast("long"))
    rows = rows.withColumn("base", _base(F.col("norm"), F.col("n_words")))
    some = F.lit(False)
    for k in COARSE:
        some = some | F.contains(F.col("norm"), F.lit(k))
    # Texts without a keyword get keys too, which meet nothing, so that they spread over the join's tasks.
    rows = rows.withColumn("some", some)
    rows = rows.withColumn("key", F.when(F.col("some"), F.sha2("norm", 256)).otherwise(F.xxhash64("norm", "doc_id").cast("string")))
    texts = where(rows, F.col("some")).select("key", "norm").dropDuplicates(["key"])
    found = detections(texts, docs.sparkSession).groupBy(F.col("key").alias("k")).agg(F.collect_set("label").alias("own"), F.max("confidence").alias("conf"))
    base = F.filter(F.transform("base", lambda b: b["label"]), lambda x: x.isNotNull())
    out = rows.select(
        "doc_id",
        "key",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"),
    )
    none = F.array().cast("array<string>")
    out = out.join(found, F.col("key") == F.col("k"), "left")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", none))), ",").alias("labels"),
        F.greatest(F.coalesce("conf", F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
