"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton gives the longest token that starts at each byte of a piece. Tokens are
taken greedily; a token is accepted only if it is compatible with the one before it, that is, if
encoding the two tokens' bytes gives just these two. Otherwise the next shorter prefix is tried, and
if none is left the previous token is given up and its start is marked as a dead end, so every
position is left at most once and the work is linear. The result is that of applying the merges in
order. Decoding gathers bytes from one blob of all token bytes through an offset table.

The tokenizer file is that of the `tokenizers` library; its path is a parameter and must be readable
by every worker. Special tokens found in a text are encoded as themselves, as that library does.

Defined results: a null or empty text has no tokens and decodes to an empty text; repeated rows are
encoded each; `encode` and `decode` replace or add just the column they are told to. Words are cached
per worker, in a cache of bounded size; a row is encoded on its own, so memory is bounded by a batch and, for a very long
text, by that text. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word pieces kept per worker, in two generations: when the newer is full it becomes the older.
CACHED_PIECES = 100_000
#: Bytes of text that a worker encodes and hands on at a time; a longer text goes alone.
SLICE_BYTES = 4 << 20
#: Fixed value: the splitting pattern of byte-level tokenizers.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters without the characters that the two classes see differently.
LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_LATIN = "[^\x00-\x1b\x20-\u024f]|[\xb2\xb3\xb9\xbc-\xbe]"


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """The tables of one tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_of_char()
        vocab = model["vocab"]
        token_bytes = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        token_bytes |= {i: t.encode() for t, i in specials.items()}
        size = max(token_bytes) + 1
        self.lengths = np.array([len(token_bytes.get(i, b"")) for i in range(size)], np.int64)
        self.sizes = self.lengths.tolist()
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(token_bytes.get(i, b"") for i in range(size)), np.uint8)
        # The rank of a merge orders merges; a token is the pair that its merge joins.
        self.made: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, token = (vocab[left], vocab[right]), vocab[left + right]
            self.made[pair] = token
            self.rank.setdefault(token, rank)
            self.halves.setdefault(token, pair)
        self.automaton = ahocorasick.Automaton()
        self.known = {token_bytes[i]: i for i in vocab.values()}
        for text, i in self.known.items():
            self.automaton.add_word(text.decode("latin-1"), (len(text), i))
        self.automaton.make_automaton()
        # The longest token that is a proper prefix of each token, or -1.
        self.prefix = [-1] * size
        for text, i in self.known.items():
            self.prefix[i] = next((j for n in range(len(text) - 1, 0, -1) if (j := self.known.get(text[:n])) is not None), -1)
        self.fits = functools.lru_cache(1 << 17)(self._fits)
        self.pieces = regex.compile(PIECES).findall
        self.latin_pieces, self.not_latin = re.compile(LATIN_PIECES).findall, re.compile(NOT_LATIN).search
        self.specials = specials
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _fits(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that make the two tokens.

        The tokens are undone from the latest merge back; `until` is the rank of the merge undone last,
        before which a joining merge would have been applied. Equal merges go from left to right.
        """
        until, until_right = len(self.rank), False
        while True:
            joined = self.made.get((left, right))
            if joined is not None and (self.rank[joined] < until or (self.rank[joined] == until and until_right)):
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                until, until_right, left = a, False, self.halves[left][1]
            else:
                until, until_right, right = b, True, self.halves[right][0]

    def piece_ids(self, piece: bytes) -> list[int]:
        if (whole := self.known.get(piece)) is not None:
            return [whole]  # the longest match, with nothing before it
        chars, fits, size = piece.decode("latin-1"), self.fits, len(piece)
        longest = [-1] * size
        for end, (n, i) in self.automaton.iter(chars):
            longest[end - n + 1] = i  # matches come by their end, so the longest of a start comes last
        sizes, dead = self.sizes, bytearray(size + 1)
        ids = []
        at, token, last, prefix = 0, longest[0], -1, self.prefix
        while at < size:
            end = at + sizes[token]
            if not dead[end] and (not at or fits(last, token)):
                ids.append(token)
                last, at = token, end
                if at < size:
                    token = longest[at]
                continue
            token = prefix[token]
            if token < 0:
                # The token that led here is tried again and refused, as its end is now dead.
                dead[at] = 1
                token = ids.pop()
                at -= sizes[token]
                last = ids[-1] if ids else -1
        return ids

    def text_ids(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        findall = self.pieces if self.not_latin(text) else self.latin_pieces
        parts = self.split.split(text) if self.split and any(s in text for s in self.specials) else [text]
        for part in parts:
            if part in self.specials:
                out.append(np.int32(self.specials[part]).tobytes())
                continue
            pieces = findall(part)
            cached = list(map(self.cache.get, pieces))
            for i, ids in enumerate(cached):
                if ids is None:
                    cached[i] = self._remember(pieces[i])
            out += cached
        return np.frombuffer(b"".join(out), np.int32)

    def _remember(self, piece: str) -> bytes:
        ids = self.cache.get(piece) or self.older.get(piece)
        if ids is None:
            ids = array("i", self.piece_ids(piece.encode())).tobytes()
        if len(self.cache) >= CACHED_PIECES:
            self.cache, self.older = {}, self.cache
        if len(piece) < 64:
            self.cache[piece] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, as UTF-8; broken sequences become replacement characters."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        index = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.blob[index].tobytes().decode("utf-8", "replace").encode()

    def ids_of(self, texts: pa.Array) -> pa.Array:
        """The ids of each text; a null has none."""
        rows = [self.text_ids(t.as_py()) if t.is_valid else np.empty(0, np.int32) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))

    def texts_of(self, arrays: pa.Array) -> pa.Array:
        """The text of each list of ids."""
        ends, flat = arrays.offsets.to_numpy(), arrays.values.to_numpy(zero_copy_only=False)
        rows = [self.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        return pa.array(rows, pa.binary()).cast(pa.string())


@functools.lru_cache(2)
def tables(path: str) -> Bpe:
    return Bpe(path)


def encode(text: Column, path: str | None = None) -> Column:
    """array<int>: the token ids of the text."""
    path = path or default_path()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return tables(path).ids_of(texts)

    return ids(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of token ids."""
    path = path or default_path()

    @F.arrow_udf("string")
    def text(arrays: pa.Array) -> pa.Array:
        return tables(path).texts_of(arrays)

    return text(ids)


def pieces_of(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about SLICE_BYTES of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        done = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded text of every row, in one pass of one worker: a text is encoded once."""
    path = path or default_path()
    rows = docs.select("doc_id", F.col(text).alias("text"))
    kinds = [rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(path)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                ids = bpe.ids_of(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, bpe.texts_of(ids)], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, T.StructType(kinds))


def digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
