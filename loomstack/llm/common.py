"""Arrow and numpy text helpers, and the tables of the shared folder.

All operators work on whole texts.  Work is cut into slices of a bounded
number of bytes; only a single text longer than the slice makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.functions.storage import Table, delete, shared_dir  # noqa: F401 - used through this module

#: Words are maximal runs of bytes other than space, \t, \n, \v, \f, \r.
WORD_RE = r"[^\x20\x09-\x0D]+"

def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that the operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])

def batch_udf(f, schema: str, inputs: int = 1):
    """A scalar Arrow UDF from a function of one or more arrays.

    It counts as nondeterministic only so that Catalyst never evaluates it
    twice (in a pushed filter and again in the projection).
    """

    def over(batches):
        for cols in batches:
            yield f(*cols) if isinstance(cols, tuple) else f(cols)

    kind = pa.Array if inputs == 1 else tuple[(pa.Array,) * inputs]
    over.__annotations__ = {"batches": Iterator[kind], "return": Iterator[pa.Array]}
    return F.arrow_udf(over, schema).asNondeterministic()

@contextmanager
def arrow_batches(spark: SparkSession, most: int = 1 << 22):
    """Plans that run inside give their Arrow functions batches of about ``most`` bytes; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)

def trim_native(spark: SparkSession) -> bool:
    """The driver's C allocator gives memory that nothing uses back to the system; False where the JVM has no command for that.

    The JVM's compiler and collector take and free native memory all the time, and glibc keeps it in arenas of many threads.
    """
    jvm = spark._jvm
    named = jvm.java.lang.Class.forName
    kinds, args = (spark.sparkContext._gateway.new_array(c, 4) for c in (jvm.java.lang.Class, jvm.java.lang.Object))
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    try:
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface's method: Py4J finds none for null arrays, and the server's own class is not open to it.
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True

# --- texts in Arrow arrays ---------------------------------------------------

def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 byte offsets of a string array; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    _, off, data = col.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]

def slices(offsets: np.ndarray, most: int = 1 << 19):
    """(first, last + 1) ranges of rows of about ``most`` bytes, at least one row each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j

# --- 64-bit hashing ----------------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x

def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, b in enumerate((_BASE, _BINV)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]

def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of byte values times powers up to i, mod 2**64."""
    up, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out

def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges [start, end); equal bytes give equal hashes."""
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

def word_spans(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE):
    """Starts and ends of words, and for each text the index of its first word (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = sep[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0], edge[1:] = True, gap
    edge[offsets[:-1][offsets[:-1] < len(buf)]] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[:-1], edge[-1] = gap, True
    edge[offsets] = True
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def ascii_lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[buf]

_STEP = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)

def shingles(words: np.ndarray, first: np.ndarray, k: int = 5):
    """Hashes of k-word shingles, in order, and for each text where its own begin (n + 1).

    A text of 1 to k - 1 words has one shingle, its whole sequence.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(begin[-1]) - begin[doc] + first[doc]
    h = np.zeros(len(at), np.uint64)
    left = first[doc + 1] - at
    for j in range(k):
        ok = left > j
        if ok.all():
            h += words[at + j] * _STEP[j]
        else:
            h[ok] += words[at[ok] + j] * _STEP[j]
    return mix(h + np.minimum(left, k).astype(np.uint64)), begin
