"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items are lower-cased and cut into words at blanks and ASCII
punctuation; features are 5-word shingles (the whole sequence where an item
is shorter).  For every distinct item size, windows of that many words are
fingerprinted (64-bit SimHash, a running sum of signed bits); ``HammingIndex``
finds all item fingerprints within ``RADIUS`` bits by four blocks of 16 bits, one
of which must agree within its share of the radius (4, 4, 4 or 3 bits); each
candidate is then verified by the exact weighted Jaccard similarity
(multiplicities of shingles) of window and item.

A window without a single shingle of any item has similarity 0 and is not
fingerprinted, which loses nothing.  At similarity 0.8 two fingerprints differ
in about 10 bits with a deviation of 3; the radius of 18 loses about 1 window
in 430 there, and fewer above.

Nothing is shuffled: the items are the stated query set, taken in blocks of
``BLOCK_ITEMS`` and ``BLOCK_BYTES`` at most, each broadcast and held against
all rows.

Edge cases: null and blank texts or items match nothing; equal items each
match; a repeated document row matches each time; of windows that match an
item the most similar, then the first, is reported; a text with fewer words
than an item is one window, compared exactly; texts are read whole; empty
tables give no match; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm.common import batch_udf, mix, prefix_hash, slices, span_hash, text_buffer, word_spans

SHINGLE, RADIUS, SIMILARITY = 5, 18, 0.8
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_SEP = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_STEP = np.random.default_rng(23).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _words(col: pa.Array):
    """For slices of texts: first row, word hashes, and each text's first word (n + 1)."""
    buf, off = text_buffer(pc.utf8_lower(col))
    for i, j in slices(off):
        part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, first = word_spans(part, o, _SEP)
        yield i, span_hash(prefix_hash(part), s, e) if len(s) else np.zeros(0, np.uint64), first


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words at each position where they fit."""
    size = max(0, len(words) - n + 1)
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h += words[k : k + size] * _STEP[k]
    return mix(h)


def _sums(features: np.ndarray) -> np.ndarray:
    """Running sums of the features' bits as +1 and -1, n + 1 rows of 64."""
    bits = np.unpackbits(features.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    out = np.zeros((len(features) + 1, 64), np.int32)
    np.cumsum(2 * bits - 1, axis=0, out=out[1:])
    return out


def _prints(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n features from each position ``at``."""
    return np.packbits(sums[at + n] - sums[at] > 0, axis=1).view(">u8").ravel().astype(np.uint64)


class HammingIndex:
    """All pairs of fingerprints within ``radius`` bits.

    The radius is shared out to four blocks of 16 bits so that shares + 1 come to
    radius + 1: of two fingerprints within it some block differs by its share at
    most.  A block's values are probed by all masks of so many bits, or compared
    with each other where an index has fewer values than there are masks.
    """

    BLOCKS, CHUNK = 4, 1 << 20

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.blocks = []
        every = np.arange(1 << 16, dtype=np.uint16)
        for k in range(self.BLOCKS):
            share = (radius + 1) // self.BLOCKS - 1 + (k < (radius + 1) % self.BLOCKS)
            values = self._values(prints, k)
            order = np.argsort(values, kind="stable")
            distinct, begin = np.unique(values[order], return_index=True)
            if share >= 0:
                self.blocks.append((k, share, order, distinct, np.append(begin, len(order)), every[np.bitwise_count(every) <= share]))

    @staticmethod
    def _values(prints: np.ndarray, k: int) -> np.ndarray:
        return (prints >> np.uint64(16 * k)).astype(np.uint16)

    def candidates(self, prints: np.ndarray):
        """(query, item) index arrays, block by block, for some queries at a time."""
        step = max(1, self.CHUNK // max(1, len(self.prints), *(min(len(b[3]), len(b[5])) for b in self.blocks)))
        for at in range(0, len(prints), step):
            for k, share, order, distinct, begin, masks in self.blocks:
                mine = self._values(prints[at : at + step], k)
                if len(distinct) <= len(masks):
                    q, v = np.nonzero(np.bitwise_count(mine[:, None] ^ distinct) <= share)
                else:
                    probes = mine[:, None] ^ masks
                    v = np.minimum(np.searchsorted(distinct, probes), len(distinct) - 1)
                    q, m = np.nonzero(distinct[v] == probes)
                    v = v[q, m]
                n = begin[v + 1] - begin[v]
                item = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[v], n)]
                yield np.repeat(q + at, n), item

    def query(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros(0, np.int64)]
        for q, item in self.candidates(prints):
            near = np.bitwise_count(prints[q] ^ self.prints[item]) <= self.radius
            found.append(q[near] * len(self.prints) + item[near])
        return np.divmod(np.unique(np.concatenate(found)), len(self.prints))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller multiplicities over the sum of the larger."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(nx[i], ny[j]).sum())
    return common / (len(a) + len(b) - common)


def _least_common(a: int, b: int, similarity: float) -> float:
    """Common shingles that sequences of a and b shingles need for the similarity, less a margin for rounding."""
    return similarity * (a + b) / (1 + similarity) - 1e-6


class ItemIndex:
    """Items by size in words, each size with a Hamming index, and all their shingles."""

    def __init__(self, ids: list, texts: list):
        self.sizes: dict[int, tuple[list, list[np.ndarray], HammingIndex]] = {}
        by_size: dict[int, list] = {}
        for i, words, first in _words(pa.array(texts, pa.string())):
            for k in range(len(first) - 1):
                w = words[first[k] : first[k + 1]]
                if len(w):
                    by_size.setdefault(len(w), []).append((ids[i + k], _grams(w, min(SHINGLE, len(w)))))
        every: dict[int, list[np.ndarray]] = {}
        for m, items in by_size.items():
            grams = [g for _, g in items]
            prints = np.concatenate([_prints(_sums(g), np.zeros(1, np.int64), len(g)) for g in grams])
            self.sizes[m] = [i for i, _ in items], grams, HammingIndex(prints)
            every.setdefault(min(m, SHINGLE), []).extend(grams)
        self.shingles = {n: np.unique(np.concatenate(g)) for n, g in every.items()}
        self.low = {n: self._bitmap(g) for n, g in self.shingles.items()}

    @staticmethod
    def _bitmap(grams: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return out

    def hits(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.low[n][(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        known = self.shingles[n]
        k = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
        return at[known[k] == grams[at]]

    def matches(self, words: np.ndarray, first: np.ndarray, similarity: float):
        """(text, item id, first word, words, similarity) of the best window of each text and item."""
        for n in self.shingles:
            grams = _grams(words, n)
            hits = self.hits(grams, n)
            doc = np.searchsorted(first, hits, "right") - 1
            inside = hits + n <= first[doc + 1]
            hits, doc = hits[inside], doc[inside]
            for d in np.unique(doc):
                yield from ((int(d), *m) for m in self._in_text(grams, hits[doc == d], int(first[d]), int(first[d + 1]), n, similarity))

    def _as_whole(self, grams, known, words, similarity):
        """The whole text as the only window of items with more words, compared exactly where its known shingles suffice."""
        for m, (ids, items, _) in self.sizes.items():
            if m > words and known >= _least_common(len(grams), m - SHINGLE + 1, similarity):
                for k, item in enumerate(items):
                    score = weighted_jaccard(grams, item)
                    if score >= similarity:
                        yield ids[k], 0, words, score

    def _in_text(self, grams, hits, lo, hi, n, similarity):
        best: dict[tuple[int, int], tuple[float, int]] = {}
        if hi - lo >= SHINGLE == n:
            yield from self._as_whole(grams[lo : hi - n + 1], len(hits), hi - lo, similarity)
        sizes = [m for m in self.sizes if min(m, SHINGLE) == n and m <= hi - lo]
        if not sizes:
            return
        for group in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * max(sizes)) + 1):
            a, b = max(lo, int(group[0]) - max(sizes)), min(hi, int(group[-1]) + max(sizes) + n)
            sums = _sums(grams[a : b - n + 1])
            for m in sizes:
                span = m - n + 1
                cover = np.zeros(b - a + 1, np.int32)
                np.add.at(cover, np.maximum(group - span + 1, a) - a, 1)
                np.add.at(cover, group + 1 - a, -1)
                starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                starts = starts[starts + m <= b - a]
                if not len(starts):
                    continue
                _, items, index = self.sizes[m]
                for q, k in zip(*index.query(_prints(sums, starts, span)), strict=True):
                    s = int(starts[q]) + a
                    score = weighted_jaccard(grams[s : s + span], items[k])
                    if score >= similarity and (score, -s) > best.get((m, int(k)), (0.0, 0)):
                        best[m, int(k)] = score, -s
        for (m, k), (score, s) in best.items():
            yield self.sizes[m][0][k], -s - lo, m, score


def item_blocks(items: DataFrame, id_col: str, text: str):
    """The items in blocks of a bounded number of rows and bytes, in no particular order."""
    ids, texts, size = [], [], 0
    for i, t in items.select(id_col, text).where(F.col(text).isNotNull()).toLocalIterator():
        ids.append(i), texts.append(t)
        size += len(t)
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


#: Indexes that a Python worker has built, by broadcast; at most so many.
KEPT_INDEXES = 2
_indexes: dict[str, ItemIndex] = {}


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) for every document and item with a similar window."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kinds = dict(rows.dtypes)["doc_id"], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word int, n_words int, similarity double"
    found = []
    for ids, texts in item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast((ids, texts))

        def leaks(batches, shared=shared):
            index = ItemIndex(*shared.value)
            for b in batches:
                for i, words, first in _words(b.column(1)):
                    got = list(index.matches(words, first, similarity))
                    if got:
                        at, *rest = zip(*got, strict=True)
                        take = b.column(0).take(pa.array([i + k for k in at], pa.int64()))
                        yield pa.RecordBatch.from_arrays([take, pa.array(rest[0], _arrow(kinds[1])), pa.array(rest[1], pa.int32()), pa.array(rest[2], pa.int32()), pa.array(rest[3])], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        found.append(rows.mapInArrow(leaks, schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` in which no item has a similar window; one pass, no join."""
    spark = docs.sparkSession
    for ids, texts in item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast((ids, texts))

        def leaky(col: pa.Array, shared=shared, key=uuid.uuid4().hex) -> pa.Array:
            index = _indexes.get(key)
            if index is None:
                if len(_indexes) >= KEPT_INDEXES:
                    _indexes.clear()
                index = _indexes[key] = ItemIndex(*shared.value)
            out = np.zeros(len(col), bool)
            for i, words, first in _words(col):
                out[[i + m[0] for m in index.matches(words, first, similarity)]] = True
            return pa.array(out)

        docs = docs.where(~batch_udf(leaky, "boolean")(F.col(text)))
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the place and the similarity."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, items).withColumn("similarity", F.round("similarity", 6))
