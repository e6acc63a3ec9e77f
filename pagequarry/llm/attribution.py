"""Token counts per field or section of a document that is encoded once, as a whole.

Each token's bytes are joined with the spans of the sections; a token that crosses a border is
allocated by a rule: `first` (section of its first byte), `most` (section that holds most of its
bytes, the earlier of equal ones) or `shared` (each section gets its share of the bytes). Spans are in
characters, must not overlap, and are matched with tokens in UTF-8 bytes, so that a character made of
several tokens is shared exactly. Bytes outside all sections count for none.

`count_tokens` makes the sections itself, one per line of each field; `attribute` takes given spans.

Defined results: a null text counts as empty; a section without characters has no tokens; null or empty
span lists give no rows; repeated rows give their rows each. Only the columns named are read. An empty table gives no
rows; a document is held whole by the worker that encodes it; of sections that hold equally many bytes the earlier one
gets the token.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = ("first", "most", "shared")
SPANS = "array<struct<field:string,section:int,start:bigint,end:bigint>>"
COLUMNS = "field string, section int, start bigint, end bigint, tokens double, crossing bigint"
#: Result rows that a worker holds at most, besides those of one document.
ROWS_OUT = 20_000
COUNTS = "array<struct<field:string,section:int,start:bigint,end:bigint,tokens:double,crossing:bigint>>"


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@functools.lru_cache(2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte span of each token of the whole text."""
    encoding, lengths = _encoder(path)
    ends = np.cumsum(lengths[encoding.encode_to_numpy(text, disallowed_special=())])
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends


def _byte_spans(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """Character spans as byte spans."""
    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    at = np.append(lead, len(raw))
    return at[np.clip(spans, 0, len(lead))]


def allocate(start: np.ndarray, end: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per span and tokens that cross a border of it. spans: sorted, disjoint byte spans."""
    counts, crossing = np.zeros(len(spans)), np.zeros(len(spans), np.int64)
    real = np.flatnonzero(spans[:, 0] < spans[:, 1])
    if not len(real) or not len(start):
        return counts, crossing
    lo, hi = spans[real, 0], spans[real, 1]
    first = np.searchsorted(hi, start, "right")  # the first span that ends behind the token's start
    last = np.searchsorted(lo, end, "left")  # the first span that begins at or behind its end
    inside = (last - first == 1) & (lo[np.minimum(first, len(lo) - 1)] <= start) & (end <= hi[np.minimum(first, len(hi) - 1)])
    counts += np.bincount(real[first[inside]], minlength=len(spans))
    for t in np.flatnonzero(~inside & (last > first)):
        own = np.arange(first[t], last[t])
        part = np.minimum(hi[own], end[t]) - np.maximum(lo[own], start[t])
        crossing[real[own]] += 1
        if rule == "shared":
            counts[real[own]] += part / (end[t] - start[t])
        elif rule == "most":
            counts[real[own[np.argmax(part)]]] += 1
        elif lo[own[0]] <= start[t]:
            counts[real[own[0]]] += 1
    return counts, crossing


def attribute(text: Column, spans: Column, rule: str = "most", path: str | None = None) -> Column:
    """The spans, each with its tokens and the number of tokens that cross one of its borders."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_path()

    @F.arrow_udf(COUNTS)
    def counted(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text_, list_ in zip(texts, lists):
            text_, own = text_.as_py() or "", list_.as_py() or []
            own = sorted(own, key=lambda s: (s["start"], s["end"]))
            chars = np.array([[s["start"], s["end"]] for s in own], np.int64).reshape(-1, 2)
            counts, crossing = allocate(*token_spans(text_, path), _byte_spans(text_.encode(), chars), rule)
            out.append([s | {"tokens": float(c), "crossing": int(x)} for s, c, x in zip(own, counts, crossing)])
        kind = pa.struct([("field", pa.string()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64())])
        return pa.array(out, pa.list_(kind))

    return counted(text, spans)


def line_spans(texts: list[str], separator: str = "\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Field number, line number and character span of each line, with its newline, of fields that are
    joined to one document."""
    fields, numbers, spans, at = [], [], [], 0
    for field, text in enumerate(texts):
        lines = text.split("\n")
        ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
        ends[-1] -= 1  # the last line has no newline
        spans.append(at + np.stack([np.append(0, ends[:-1]), ends], 1))
        fields.append(np.full(len(lines), field, np.int32))
        numbers.append(np.arange(len(lines), dtype=np.int32))
        at += len(text) + len(separator)
    return np.concatenate(fields), np.concatenate(numbers), np.concatenate(spans)


def count_tokens(docs: DataFrame, fields: list[str], rule: str = "most", path: str | None = None, separator: str = "\n") -> DataFrame:
    """doc_id, field, section, start, end, tokens, crossing: one row per line of each field of each document.

    One pass of one worker; rows are handed on every ROWS_OUT lines, so memory is bounded by a document.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_path()
    named = [f"f{i}" for i in range(len(fields))]
    rows = docs.select("doc_id", *[docs[f].cast("string").alias(n) for f, n in zip(fields, named)])
    kinds = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(COLUMNS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(fields, pa.string())
        for batch in batches:
            out, held = [], 0
            for row in range(batch.num_rows):
                texts = [batch.column(n)[row].as_py() or "" for n in named]
                field, section, chars = line_spans(texts, separator)
                text = separator.join(texts)
                counts, crossing = allocate(*token_spans(text, path), _byte_spans(text.encode(), chars), rule)
                out.append((np.full(len(field), row), field, section, chars[:, 0], chars[:, 1], counts, crossing))
                held += len(field)
                if held >= ROWS_OUT or row + 1 == batch.num_rows:
                    at, field, *rest = map(np.concatenate, zip(*out))
                    columns = [batch.column("doc_id").take(pa.array(at)), names.take(pa.array(field)), *map(pa.array, rest)]
                    yield pa.RecordBatch.from_arrays(columns, names=kinds.names)
                    out, held = [], 0

    return rows.mapInArrow(run, kinds)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of source, lang and each line of the text, from one encoding of the three together."""
    rows = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["source", "lang", "text"])
    return rows.select("doc_id", "field", "section", "start", "end", F.col("tokens").cast("long").alias("n_tokens"), F.col("crossing").alias("n_crossing"))
