"""Exact substring dedup by prefix-free parsing.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
earlier: in a document of smaller id, or earlier in the same one.

Parsing.  A rolling hash of ``TRIGGER`` bytes is taken at every position; the
least one inside a 100-byte window is the window's trigger (the leftmost of
equals), so equal windows have equal triggers at equal places.  Neighbouring
windows with one trigger form a phrase.  Phrases overlap by 99 bytes, so each
window is a suffix of exactly one phrase, cut at 100 bytes: the parse (phrases
in the order of the corpus) and the dictionary (distinct phrases) hold all
windows.

Parse order.  Of equal phrases all but the first in the order of documents and
places are repeated whole.

Dictionary order.  Only windows of phrases that share a trigger can be equal.
The distinct phrases of such triggers are sent to tasks as bytes, and each task
builds the suffix array of its part of the dictionary by prefix doubling over
the bytes themselves (8, 16, 32, 64, then 100).  Suffixes of one interval of a
common prefix of 100 bytes are put in corpus order by the parse positions of
their phrases; all but the first are repeated.  Matches end at 100 bytes, so
neither array is needed beyond that depth.

Distribution.  Documents are packed in chunks of about ``CHUNK`` bytes, stored
as a table bucketed by chunk, so no later step moves texts.  A chunk sends one
row for each of its distinct phrases; a frequent phrase is one row a chunk.
The phrases of a trigger that has over ``WIDE`` of them are not sorted in one
task: Spark aggregates their windows, with partial sums, and splits the join.

Edge cases: null and empty texts have no bytes; texts under ``LENGTH`` bytes
keep all; repeated rows of an id count as later copies in the order of chunks;
null ids come first; texts are read whole, one over the block size in blocks;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.llm.common import Table, delete, prefix_hash, shared_dir, span_hash, text_buffer

LENGTH, TRIGGER = 100, 50
#: Bytes of a chunk: at least, and at most; about 1 / CHUNKS of the corpus between.
CHUNK, CHUNK_MOST, CHUNKS = 1 << 20, 32 << 20, 50_000
#: Phrases of one part of the dictionary, and of one trigger that a task may sort.
PART, WIDE = 1 << 14, 1 << 15
_BLOCK, _LOW = (1 << 20) - 256, np.uint64((1 << 20) - 1)


def _blocks(off: np.ndarray):
    """(first byte, last byte + 1, starts of windows + 1, offsets of texts) of runs of texts, or parts of a long text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _BLOCK, "right")) - 1)
        for lo in range(int(off[i]), int(off[j]), _BLOCK) if off[j] - off[i] > _BLOCK else (int(off[i]),):
            stop = min(int(off[j]), lo + _BLOCK)
            hi = min(int(off[j]), stop + LENGTH - 1)
            yield lo, hi, stop - lo, np.clip(off[i : j + 1], lo, hi) - lo
        i = j


def parse(buf: np.ndarray, off: np.ndarray):
    """Phrases of texts in order: trigger hash, phrase hash, first window, last window + 1 (byte positions)."""
    out = []
    for lo, hi, starts, o in _blocks(off):
        part = buf[lo:hi]
        n = len(part) - LENGTH + 1
        if n <= 0:
            continue
        prefix, at = prefix_hash(part), np.arange(len(part) - TRIGGER + 1)
        h = span_hash(prefix, at, at + TRIGGER)
        least, size, span = (h & ~_LOW) | at.astype(np.uint64), 1, LENGTH - TRIGGER + 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: size - span], least[span - size :])
        end = np.repeat(o[1:], np.diff(o))[:n]
        w = np.arange(n)
        w = w[(w + LENGTH <= end) & (w < starts)]
        if not len(w):
            continue
        t = (least[w] & _LOW).astype(np.int64)
        new = np.ones(len(w), bool)
        new[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1] + 1)
        a = np.flatnonzero(new)
        first, stop = w[a], np.append(w[a[1:] - 1], w[-1]) + 1
        place = (t[a] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out.append((h[t[a]], span_hash(prefix, first, stop + LENGTH - 1) + place, first + lo, stop + lo))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2


def suffix_ranks(buf: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Rank of the suffix at each byte among all suffixes cut at ``depth`` bytes (8 at least); equal prefixes have equal ranks."""
    n = len(buf)
    word, padded = np.zeros(n, np.uint64), np.concatenate([buf, np.zeros(8, np.uint8)])
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n]
    rank, size = np.unique(word, return_inverse=True)[1], 8
    while size < depth:
        step = min(size, depth - size)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1]
        size += step
    return rank


def first_of_each(phrase: np.ndarray, trigger: np.ndarray) -> np.ndarray:
    """A boolean for each phrase of a chunk: none before it is equal."""
    order = np.lexsort((np.arange(len(phrase)), phrase, trigger))
    new = np.ones(len(order), bool)
    new[1:] = (phrase[order][1:] != phrase[order][:-1]) | (trigger[order][1:] != trigger[order][:-1])
    out = np.empty(len(order), bool)
    out[order] = new
    return out


# A phrase's place is (id, chunk, at): at = first window * 64 + number of windows (at most 51), and grows with the place in the chunk.


def _places(ids: pa.Array, off: np.ndarray, first: np.ndarray, stop: np.ndarray):
    doc = np.searchsorted(off, first, "right") - 1
    return ids.take(pa.array(doc)), pa.array(first * 64 + (stop - first))


def _entries(chunk: int, ids: pa.Array, off: np.ndarray, buf: np.ndarray):
    """A row for each distinct phrase of a chunk, at its first place."""
    trigger, phrase, first, stop = parse(buf, off)
    head = np.flatnonzero(first_of_each(phrase, trigger))
    if len(head):
        i, at = _places(ids, off, first[head], stop[head])
        yield pa.RecordBatch.from_arrays([pa.array(trigger[head].view(np.int64)), pa.array(phrase[head].view(np.int64)), i, pa.array(np.full(len(head), chunk)), at], ["trigger", "phrase", "id", "chunk", "at"])


def _pieces(chunk: int, ids: pa.Array, off: np.ndarray, buf: np.ndarray, asked: pa.Array):
    """The bytes of the phrases asked for."""
    if asked is None or not len(asked):
        return
    at = asked.field("at").to_numpy()
    first, n = at >> 6, at & 63
    size = n + LENGTH - 1
    cut = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.arange(cut[-1]) - np.repeat(cut[:-1] - first, size)]
    i, _ = _places(ids, off, first, first + n)
    body = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    yield pa.RecordBatch.from_arrays([asked.field("trigger"), i, pa.array(np.full(len(at), chunk)), asked.field("at"), asked.field("wide"), body], ["trigger", "id", "chunk", "at", "wide", "bytes"])


def _later_suffixes(t: pa.Table) -> pa.Table:
    """(chunk, at, mask): windows of a part of the dictionary that start earlier, as bits."""
    buf, off = text_buffer(t.column("bytes").combine_chunks())
    ids, chunk, at = t.column("id"), t.column("chunk").to_numpy(), t.column("at").to_numpy()
    n = at & 63
    begin = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(owner)) - begin[owner]
    rank = suffix_ranks(buf)[off[owner] + j]
    known, number = ids.is_valid().to_numpy(), ids.fill_null(0).to_numpy()
    order = np.lexsort(((at >> 6)[owner] + j, chunk[owner], number[owner], known[owner], rank))
    later = np.zeros(len(owner), bool)
    later[order[1:]] = rank[order][1:] == rank[order][:-1]
    mask = np.add.reduceat(later.astype(np.int64) << j, begin) if len(n) else np.zeros(0, np.int64)
    some = np.flatnonzero(mask)
    return pa.table([pa.array(chunk[some]), pa.array(at[some]), pa.array(mask[some])], ["chunk", "at", "mask"])


def _repeated(off: np.ndarray, buf: np.ndarray, answers: pa.Array | None) -> np.ndarray:
    """A boolean for each byte of a chunk: it is to be removed."""
    trigger, phrase, first, stop = parse(buf, off)
    edge = np.zeros(len(buf) + 1, np.int32)

    def cover(a: np.ndarray, b: np.ndarray):
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)

    later = ~first_of_each(phrase, trigger)
    cover(first[later], stop[later] + LENGTH - 1)
    if answers is not None and len(answers):
        at, mask = answers.field("at").to_numpy(), answers.field("mask").to_numpy()
        k, j = np.nonzero(np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        inside = j < (at & 63)[k]
        start = (at >> 6)[k[inside]] + j[inside]
        cover(start, start + LENGTH)
    return np.cumsum(edge[:-1]) > 0


def _pack(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, ids, offsets, data): documents of a chunk in the order of their ids, nulls first."""

    def pack(batches):
        part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
            data = [texts[i] for i in order]
            off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([off.tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())], ["chunk", "ids", "offsets", "data"])

        for b in batches:
            buf, off = text_buffer(b.column(1))
            raw = buf.tobytes()
            for k, i in enumerate(b.column(0).to_pylist()):
                ids.append(i)
                texts.append(raw[off[k] : off[k + 1]])
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield row()
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(pack, "chunk long, ids array<long>, offsets binary, data binary")


def _each(chunks: DataFrame, f, schema: str, answers: DataFrame | None = None) -> DataFrame:
    """``f`` of every chunk and the list of its answers; texts stay where they are."""
    columns = ["chunk", "ids", "offsets", "data"]
    if answers is not None:
        lists = answers.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in answers.columns if c != "chunk"])).alias("answers"))
        chunks, columns = chunks.join(lists, "chunk", "left"), [*columns, "answers"]

    def over(batches):
        for b in batches:
            for r in range(b.num_rows):
                c, ids, off, data, *got = (x[r] for x in b.columns)
                yield from f(c.as_py(), ids.values, np.frombuffer(off.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.uint8), *(a.values for a in got))

    return chunks.select(*columns).mapInArrow(over, schema)


def _wide_windows(pieces: DataFrame, rows: int) -> tuple[DataFrame, Table]:
    """(chunk, at, mask) for phrases of triggers that have too many for a task, by aggregates that Spark can split."""
    windows = pieces.select("id", "chunk", "at", "bytes", F.explode(F.expr("sequence(0, cast(at & 63 as int) - 1)")).alias("j"))
    windows = windows.select("id", "chunk", "at", "j", (F.shiftright("at", 6) + F.col("j")).alias("start"), F.expr(f"substring(bytes, j + 1, {LENGTH})").alias("window"))
    place = F.min(F.struct("id", "chunk", "start")).alias("f")
    firsts = Table(windows.groupBy("window").agg(place, F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "f.chunk", "f.start").toDF("window", "fc", "fs"), "wide", rows)
    later = windows.join(firsts.df.hint("merge"), "window").where("chunk <> fc OR start <> fs")
    return later.groupBy("chunk", "at").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask")), firsts


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and ``kept`` (bytes) on request."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes = int(min(CHUNK_MOST, max(CHUNK, total // CHUNKS)))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A trigger covers 26 windows on average.
    expected = total // 26
    name, used = f"chunks_{uuid.uuid4().hex}", []
    path = f"{shared_dir(spark)}/{name}"

    def table(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
        used.append(Table(df, tag, rows))
        return used[-1].df

    def removed(chunk, ids, off, buf, answers):
        gone, n = _repeated(off, buf, answers), len(ids)
        sums = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = off[:-1][(off[:-1] < len(gone))]
        begins[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = [buf[off[i] : off[i + 1]][~gone[off[i] : off[i + 1]]].tobytes() for i in range(n)]
        cols = [ids, pa.array(np.diff(off)), pa.array(np.diff(sums[off])), pa.array(np.diff(spans[off])), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([*cols, *[pa.array(kept, pa.binary())] * with_text], [*names, *["kept"] * with_text])

    try:
        write = _pack(rows, chunk_bytes).write.format("parquet").option("compression", "zstd").option("parquet.block.size", 16 << 20).option("path", path)
        write.bucketBy(max(shuffled, -(-total // (16 << 20))), "chunk").saveAsTable(name)
        chunks = spark.table(name)
        parsed = _each(chunks, _entries, "trigger long, phrase long, id long, chunk long, at long")
        again = F.row_number().over(W.partitionBy("trigger", "phrase").orderBy("id", "chunk", "at")) > 1
        phrases = table(parsed.select("trigger", "chunk", "at", again.alias("again")), "phrases", expected)
        heads = phrases.where("not again").select("trigger", "chunk", "at")
        shared = table(heads.groupBy("trigger").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("trigger", (F.col("n") > WIDE).alias("wide")), "triggers", expected)
        asked = heads.join(shared.hint("merge"), "trigger")
        pieces = table(_each(chunks, _pieces, "trigger long, id long, chunk long, at long, wide boolean, bytes binary", asked), "pieces")
        parts = max(shuffled, -(-pieces.count() // PART))
        part = F.pmod(F.xxhash64("trigger"), F.lit(parts)).alias("part")
        later = pieces.where("not wide").groupBy(part).applyInArrow(_later_suffixes, "chunk long, at long, mask long")
        wide, firsts = _wide_windows(pieces.where("wide"), expected)
        used.append(firsts)
        answers = phrases.where("again").select("chunk", "at", F.lit(-1).cast("long").alias("mask")).unionByName(later).unionByName(wide)
        schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
        return Table(_each(chunks, removed, schema, answers), "substrings").df
    finally:
        for t in used:
            t.drop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM d, unnest(range(0, n - 99)) AS r(i)),
f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT *, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, -1) AS fresh FROM f),
s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM g),
r AS (SELECT doc_id, g, min(i) AS b, max(i) + 100 AS e FROM s GROUP BY 1, 2),
k AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a, b, e FROM r),
j AS (SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS removed, count(*) AS spans, max(e) AS last, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""
