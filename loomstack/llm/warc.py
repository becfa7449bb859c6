"""Dictionary-compressed WARC archives (.warc.zst).

A Zstandard dictionary is built from a bounded sample of the records to be
archived.  Each archive starts with a skippable frame (magic 0x184D2A5D) that
holds the dictionary, then has one Zstandard frame for each record, so that
a record can be read alone.  Of equal payloads one is a ``response``, the
others are ``revisit`` records that refer to it.

Archives are rows (archive, content) of at most about ``ARCHIVE_BYTES`` each,
written by executors through Spark's writer: tasks never write to a folder of
their own machine, and a task that runs again replaces its output.

Edge cases: null html is an empty payload; a null URL is written as
``urn:none``; a null id is the record ``null`` and never the one others refer
to if any equal payload has an id; rows that repeat an id and payload are each
written, as responses if theirs is the largest id; an empty table gives no
archive; columns beyond the three named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm.common import Table

DICT_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 4 << 20
#: The dictionary's size, and the bounds of the sample it is built from.
DICT_BYTES, SAMPLE_ROWS, SAMPLE_MOST = 1 << 16, 400, 1 << 16
_URN = "urn:loomstack:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit, whose block is the HTTP head only."""
    revisit = refers_to is not None
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")
    block = _HEAD + str(len(payload)).encode() + b"\r\n\r\n" + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its block headers."""
    head = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    last = False
    while not last:
        b = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = b & 1, b >> 1 & 3, b >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * head.has_checksum


def read_archive(content: bytes):
    """(headers, payload) of each record; a revisit's payload is None.  Lengths and digests are checked."""
    view, at, unpack = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic == DICT_MAGIC:
            unpack = zstandard.ZstdDecompressor(dict_data=_dict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        end = frame_end(view, at)
        raw = unpack.decompress(view[at:end])
        at = end
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        http, _, payload = block.partition(b"\r\n\r\n")
        fields["payload_bytes"] = int(http.rpartition(b": ")[2])
        if fields["WARC-Type"] == "response":
            if len(payload) != fields["payload_bytes"] or "sha1:" + payload_digest(payload) != fields["WARC-Payload-Digest"]:
                raise ValueError("a payload does not match its digest")
            yield fields, payload
        else:
            yield fields, None


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least_revisit: int = 0) -> Table:
    """Archive every row; of equal payloads of ``least_revisit`` bytes or more the largest id is the response."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    some = rows.select("payload").where(F.length("payload").between(1, SAMPLE_MOST)).take(SAMPLE_ROWS)
    shared = spark.sparkContext.broadcast(build_dictionary([record(i, None, bytes(r[0])) for i, r in enumerate(some)]))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keep = rows.where(F.length("payload") >= least_revisit).groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A table, not an aggregate, so that Spark can split the copies of a frequent page over tasks.
    kept = Table(keep.drop("n"), "warc-keep", pages.count())
    marked = rows.join(kept.df, "digest", "left").select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("keep")), F.col("keep")).cast("string").alias("refers_to"))

    def pack(batches):
        data = shared.value
        head = struct.pack("<II", DICT_MAGIC, len(data)) + data if data else b""
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dict(data), write_checksum=True)
        part, k, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{k:05d}.warc.zst"]), pa.array([head + b"".join(parts)], pa.binary())], ["archive", "content"])

        for b in batches:
            for i, u, p, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.append(packer.compress(record(i, u, p, r)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield row()
                    k, parts, size = k + 1, [], 0
        if parts:
            yield row()

    out = Table(marked.mapInArrow(pack, "archive string, content binary"), "warc")
    kept.drop()
    return out


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of (archive, content) rows; ids as text."""
    names = ["archive", "id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * with_payload]
    plain = lambda x: x and x.strip("<>").removeprefix(_URN)

    def unpack(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows = [[name.as_py(), plain(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["payload_bytes"], f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], plain(f.get("WARC-Refers-To")), *[p] * with_payload] for f, p in read_archive(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "archive string, id string, uri string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    return archives.select("archive", "content").mapInArrow(unpack, schema)


def save_archives(archives: DataFrame, folder: str) -> int:
    """Write each archive as a file of its name through Spark's Hadoop file system, one archive in the driver at a time; the number written."""
    spark, n = archives.sparkSession, 0
    for n, r in enumerate(archives.select("archive", "content").toLocalIterator(), 1):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r[0]}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(r[1]))
        out.close()
    return n


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    back = read_archives(archives.df)
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return back.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep, sha1(h) AS hex FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM k
"""
