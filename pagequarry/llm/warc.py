"""WARC archives in seekable Zstandard bundles.

Every page becomes a WARC record: a response with its payload, or a revisit that refers to the
response with an equal payload and the smallest page id. Records are packed into frames that can be
decompressed on their own; a bundle file is a run of frames and a footer, the seek table of the
Zstandard seekable format (a skippable frame with each frame's sizes). An index table maps record ids
to bundle, frame and offset in the frame, so one record is read with one ranged read.

Tasks write bundles under names of their own attempt; the index, written by Spark's committer, names the
bundles that count, so a repeated or lost task leaves at most a file that nothing refers to. The
folder must be shared and reachable for pyarrow.fs (file, hdfs, s3, gs).

Defined results: a null html is an empty payload; rows with a null page id or url are written as they are
(the id reads back as null, the url is left out); equal rows are all responses, since each has the
smallest id; an empty table gives no bundle and no row. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.sources.storage import new_folder

#: Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
#: Records of payloads under so many bytes never revisit.
LEAST_BYTES = 0
#: WARC-Date of the records; an input, never the clock.
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, bundle string, frame int, at long, length long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _id(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{record_id(page_id)}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = url.replace("%", "%25").replace("\n", "%0A").replace("\r", "%0D")
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{record_id(refers_to)}>", "WARC-Profile": PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset of a frame, and the offset behind it."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at:body].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) for line in lines[1:] if line)
    end = body + int(head["Content-Length"])
    block = data[body:end]
    split = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[:split].decode().split("\r\n")[1:] if line)
    payload = block[split:] if head["WARC-Type"] == "response" else None
    named = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and digest(payload) != named:
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    refers = head.get("WARC-Refers-To")
    uri = head.get("WARC-Target-URI")
    return {
        "page_id": _id(head["WARC-Record-ID"]),
        "url": None if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": head["WARC-Type"],
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": named,
        "refers_to": _id(refers) if refers else None,
        "payload": payload,
    }, end + 4


class Bundle:
    """Writes one bundle file."""

    def __init__(self, files, path: str, level: int):
        import zstandard

        self.out, self.packer = files.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.open, self.size = bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.open and len(self.open) + len(data) > FRAME_BYTES:
            self.close_frame()
        at = len(self.open)
        self.open += data
        return len(self.frames), at

    def close_frame(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.open)))
        self.size += len(packed)
        self.open = bytearray()

    def close(self) -> None:
        if self.open:
            self.close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of every frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * width)
    raw, at, out = file.read(n * width), 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _frame(file, table: list[tuple[int, int, int]], k: int) -> bytes:
    import zstandard

    at, packed, plain = table[k]
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def firsts(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, sha, refers_to of the pages whose payload an earlier page has. No payload is shuffled."""
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes).select("page_id", sha.alias("sha"))
    groups = rows.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(groups, "sha").where(F.col("page_id") > F.col("refers_to")).distinct()


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str = DATE, level: int = 3) -> DataFrame:
    """Write the pages as bundles into the folder and return the index, a table in the same folder."""
    _files(folder)[0].create_dir(_files(f"{folder}/bundles")[1], recursive=True)
    pages = pages.select("page_id", "url", "html")
    repeats = firsts(pages, least_bytes).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to")
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.withColumn("sha", sha).join(repeats, (F.col("page_id") == F.col("p")) & (F.col("sha") == F.col("s")), "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(f"{folder}/bundles")
        task, n, bundle, index = TaskContext.get(), 0, None, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                if bundle is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{n}.warc.zst"
                    bundle, n = Bundle(files, f"{root}/{name}", level), n + 1
                page = page_id.as_py()
                data = record(page, url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), date)
                frame, at = bundle.add(data)
                index.append((record_id(page), page, name, frame, at, len(data)))
                if bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["record_id", "page_id", "bundle", "frame", "at", "length"])
                index = []
        if bundle is not None:
            bundle.close()

    rows.select("page_id", "url", "html", "refers_to").mapInArrow(pack, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Over a given number of tasks: a shuffle this small would else be coalesced to one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles that the index names, frame after frame."""
    # Dealt out in turn: by bundle they lie already, so that a shuffle by bundle would be left out.
    names = _spread(index.select("bundle").distinct())

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(f"{folder}/bundles")
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with files.open_input_file(f"{root}/{name}") as file:
                    table = seek_table(file)
                    for k in range(len(table)):
                        data, at, rows = _frame(file, table, k), 0, []
                        while at < len(data):
                            row, at = parse(data, at)
                            rows.append(row if payloads else row | {"payload": None})
                        yield _batch(rows)

    return names.mapInArrow(unpack, RECORDS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))


def read_records(index: DataFrame, folder: str, record_ids: DataFrame) -> DataFrame:
    """The records named in a table with a column record_id, by ranged reads of their frames."""
    wanted = index.join(record_ids.select("record_id").distinct(), "record_id").select("bundle", "frame", "at")
    wanted = _spread(wanted, "bundle").sortWithinPartitions("bundle", "frame", "at")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(f"{folder}/bundles")
        last, data, file, table = (None, None), b"", None, []
        for batch in batches:
            for name, k, at in zip(*(c.to_pylist() for c in batch.columns)):
                if name != last[0]:
                    file = files.open_input_file(f"{root}/{name}")
                    table = seek_table(file)
                if (name, k) != last:
                    last, data = (name, k), _frame(file, table, k)
                yield _batch([parse(data, at)[0]])

    return wanted.mapInArrow(unpack, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, f"warc-{uuid.uuid4().hex[:8]}")
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_bundles(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHUNKS = "list_transform(range(0, 4), lambda c: ('0x' || substr(sha, c * 10 + 1, 10))::BIGINT)"
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform({_CHUNKS}, lambda v: array_to_string(list_transform(range(0, 8),
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (35 - 5 * k)::INT) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f USING (sha)
"""
