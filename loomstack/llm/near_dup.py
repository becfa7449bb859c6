"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every document gets its set of distinct 5-word shingles (64-bit hashes), a
   128-bit hash of the set and a signature of ``K`` coordinates.  Documents of
   equal sets form a class, which is numbered and knows one row of its own by
   a hash of id and text; only classes go on, so copies never meet in pairs.
2. A class is posted under each (coordinate, value).  Two classes over the
   threshold agree in ``T`` of ``K`` coordinates (at Jaccard 0.8 the chance to
   miss is about 3e-5 a link, at 0.85 6e-7, at 0.9 1e-9).  Lists of one class
   are dropped.  Prefix and skip: in the order of list lengths, two classes
   with T agreements share one of their K - T + 1 rarest coordinates, so only
   those are merged; the longest lists are skipped.
3. Each list first links its members to its smallest member, and only pairs
   that agree in T coordinates and whose full sets pass the exact threshold
   count.  What that leaves open, members of one list in different components,
   is paired by exact prefix and position filters on the full sets, so no link
   between components is lost and pairs within one are never made.

Edge cases: null, empty and blank texts have no shingles and are alone; a text
of fewer than 5 words has one shingle; repeated rows fall into one class; an id
may stand for several texts, each linked for itself; null ids take part, but a
component's id is its smallest other id, null if there is none; an empty table
gives an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm.common import Table, arrow_batches, ascii_lower, batch_udf, mix, prefix_hash, shingles, slices, span_hash, text_buffer, word_spans
from loomstack.llm.graph import connected_components

K, T, SHINGLE = 32, 16, 5
#: Bits of the broadcast filter of ids (2 MB); it only spares work, so it need not grow.
FILTER_BITS = 1 << 24
_SEED = np.random.default_rng(5).integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1)


def shingle_sets(col: pa.Array, k: int = SHINGLE):
    """For slices of texts: sorted distinct shingles and where each text's begin (n + 1)."""
    buf, off = text_buffer(col)
    for i, j in slices(off):
        part, o = ascii_lower(buf[off[i] : off[j]]), off[i : j + 1] - off[i]
        s, e, first = word_spans(part, o)
        if not len(s):
            yield np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64)
            continue
        h, begin = shingles(span_hash(prefix_hash(part), s, e), first, k)
        doc = np.repeat(np.arange(j - i), np.diff(begin))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield h, np.searchsorted(doc, np.arange(j - i + 1))


def _signatures(col: pa.Array) -> pa.Array:
    n, lo, hi, sig = [], [], [], []
    for h, begin in shingle_sets(col):
        size = np.diff(begin)
        full = np.flatnonzero(size)
        a, b, s = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64), np.zeros((len(size), K), np.uint32)
        if len(full):
            at = begin[full]
            a[full] = np.add.reduceat(mix(h), at)
            b[full] = np.add.reduceat(mix(h * _SEED[0]), at)
            for c in range(K):
                x = (h ^ (h >> np.uint64(31))) * _SEED[c]
                s[full, c] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at)
        n.append(size), lo.append(a.view(np.int64)), hi.append(b.view(np.int64))
        sig += [r.tobytes() for r in s]
    flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.StructArray.from_arrays([flat(n), flat(lo), flat(hi), pa.array(sig, pa.binary())], ["n", "lo", "hi", "sig"])


def _postings(sig: pa.Array) -> pa.Array:
    """The (coordinate, value) pairs of each signature as numbers."""
    raw = np.frombuffer(b"".join(sig.to_pylist()), np.uint32).astype(np.int64).reshape(-1, K)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * K), pa.array((raw + (np.arange(K) << 32)).ravel()))


def _agreements(x: pa.Array, y: pa.Array) -> pa.Array:
    a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, K) for c in (x, y))
    return pa.array((a == b).sum(1).astype(np.int32))


def _sets(col: pa.Array) -> pa.Array:
    """The set of each text, and the first half of its hash as in ``_signatures``."""
    sets = [h[begin[i] : begin[i + 1]] for h, begin in shingle_sets(col) for i in range(len(begin) - 1)]
    lo = np.array([mix(h).sum(dtype=np.uint64) for h in sets], np.uint64).view(np.int64)
    return pa.StructArray.from_arrays([pa.array([h.tobytes() for h in sets], pa.binary()), pa.array(lo)], ["set", "lo"])


def _spot():
    return F.pmod(F.col("row"), F.lit(FILTER_BITS)).cast("int")


def row_key(id_col: str = "doc_id", text: str = "text"):
    """A hash of id and text; only rows equal in both share it."""
    return F.xxhash64(F.lit(5), id_col, F.col(id_col).isNull(), text)


def _bitmap(rows: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits, set at the spots of ``rows``; built by aggregation, 4 KB a group."""
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    s = rows.select(_spot().alias("s"))
    groups = s.groupBy(F.shiftright("s", 15).alias("g")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit((1 << 15) - 1)).cast("long")).alias("b"))
    for g, b in groups.collect():
        out[g] = np.frombuffer(bytes(b), np.uint8)
    return out.ravel()


def _numbers(col: pa.Array) -> pa.Array:
    n = np.concatenate([[0], np.cumsum([len(x.as_buffer()) // 8 for x in col])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(n), pa.array(np.frombuffer(b"".join(col.to_pylist()), np.int64)))


def _common(x: pa.Array, y: pa.Array) -> pa.Array:
    sets = ((np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(x, y, strict=True))
    return pa.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in sets], pa.int64())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(id, row, n_shingles, component_id, head) for every row of ``docs``.

    Documents are linked where 100 * common >= ``percent`` * union of their sets.
    ``row`` is the row's ``row_key``; ``head`` is true for one of them in each
    component (with the smallest id), and for every document without a word.
    """
    # All that Python does is done in tables; a worker holds the texts or pairs of sets of one batch, with its copies of them.
    with arrow_batches(docs.sparkSession):
        return _linked_rows(docs, id_col, text, percent)


def _linked_rows(docs: DataFrame, id_col: str, text: str, percent: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn("row", row_key("id"))
    signed = Table(rows.select("id", "row", batch_udf(_signatures, "n long, lo long, hi long, sig binary")("text").alias("s")).select("id", "row", "s.*"), "signed")
    n = signed.df.count()
    head = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    grouped = signed.df.where("n > 0").groupBy("lo", "hi", "n").agg(F.min(head).alias("head"), F.first("sig").alias("sig"))
    # Numbers follow the least ids: the first of a group is the likeliest to be what the others were made from.
    ordered = grouped.repartitionByRange("head").sortWithinPartitions("head")
    classes = Table(ordered.withColumn("c", F.monotonically_increasing_id()), "classes", rows=n)
    posted = classes.df.select("c", F.explode(batch_udf(_postings, "array<long>")("sig")).alias("key"))
    # Tables, not aggregates, so that Spark can split the members of a long list over tasks.
    lists = Table(posted.groupBy("key").agg(F.count(F.lit(1)).alias("len")).where("len > 1"), "lists", rows=8 * n)
    # A class has K - r coordinates of its own; of its r others the r - T + 1 rarest are in the prefix.
    mine = posted.join(lists.df.hint("merge"), "key").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("len", "key"))).alias("p")).where(F.size("p") >= T)
    rarest = mine.select("c", F.explode(F.slice("p", 1, F.size("p") - (T - 1))).alias("e")).select("c", F.col("e.key").alias("key"))
    # A list is split by size: sets over the threshold differ by one band at most, and each is in two neighbouring bands.
    band = F.floor(F.ln("n") / F.lit(1.0001 * math.log(100 / min(percent, 99))))
    tagged = rarest.join(classes.df.select("c", "n"), "c").select("c", "key", F.explode(F.array(band, band + 1)).alias("band"))
    prefix = Table(tagged, "prefix", rows=8 * n)
    # Lists may have lost members to the prefix; those of one class are no use.
    heads = Table(prefix.df.groupBy("key", "band").agg(F.min("c").alias("head"), F.count(F.lit(1)).alias("len")).where("len > 1").drop("len"), "heads", rows=n)
    stars = prefix.df.join(heads.df.hint("merge"), ["key", "band"]).where("c <> head").groupBy(F.col("head").alias("a"), F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    known = Table(classes.df.join(prefix.df.select("c").distinct(), "c", "left_semi").select("c", "n", "lo", "sig", F.col("head.row").alias("row")), "near-sig", rows=n)

    def agreeing(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that agree in T coordinates and whose sizes allow the threshold."""
        x = known.df.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        y = known.df.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        both = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return both.withColumn("same", batch_udf(_agreements, "int", 2)("sa", "sb")).where(f"same >= {T}").drop("sa", "sb")

    # Only texts of these rows are shuffled: a filter of FILTER_BITS drops most others first, the join all.
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(known.df))

    def perhaps(p: pa.Array) -> pa.Array:
        at = p.to_numpy()
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    involved = rows.where(batch_udf(perhaps, "boolean")(_spot())).join(known.df.select("row", "c", "n", "lo"), "row").select("c", "n", "lo", batch_udf(_sets, "set binary, lo long")("text").alias("s"))
    sets = Table(involved.where("length(s.set) = 8 * n and s.lo = lo").select("c", "s.set").dropDuplicates(["c"]), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of agreeing pairs those whose full sets pass the threshold."""
        x, y = sets.df.select(F.col("c").alias("a"), F.col("set").alias("x")), sets.df.select(F.col("c").alias("b"), F.col("set").alias("y"))
        full = pairs.join(x, "a").join(y, "b").withColumn("common", batch_udf(_common, "long", 2)("x", "y"))
        return full.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    first = Table(agreeing(stars), "stars", rows=n)
    best = first.df.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("same", -F.col("a"))).alias("m")).select("m.*", "b")
    links = Table(linked(best), "links-1", rows=n)
    found = connected_components(links.df, n)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        x, y = found.df.select(F.col("id").alias("a"), F.col("component").alias("ca")), found.df.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    more = Table(linked(apart(first.df)), "links-2", rows=n)
    all_links = links.df.union(more.df)
    if more.df.limit(1).count():
        found.drop()
        found = connected_components(all_links, n)
    member = prefix.df.join(found.df.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    mixed = Table(member.groupBy("key", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "band"), "mixed", rows=n)
    # Open: members of a list with more than one component.  Their sets are joined by the exact prefix and
    # position filters: in the order of frequency, sets over the threshold share one of their n - ceil(t n) + 1
    # rarest shingles, and what is left after a shared one bounds what they can have in common.
    member = Table(member.join(mixed.df.hint("merge"), ["key", "band"], "left_semi").select("c", "component").distinct(), "open", rows=n)
    bits = sets.df.join(member.df, "c").select("c", "component", (F.length("set") / 8).cast("long").alias("n"), F.explode(batch_udf(_numbers, "array<long>")("set")).alias("s"))
    bits = Table(bits, "open-sets", rows=64 * n)
    often = Table(bits.df.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "open-often", rows=8 * n)
    need = lambda x: F.floor((x * percent + 99) / 100).cast("long")
    rare = bits.df.join(often.df.hint("merge"), "s").groupBy("c", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("p"))
    # The n - size(p) shingles of its own come first.
    alone = F.col("n") - F.size("p")
    posts = rare.select("c", "component", "n", F.posexplode(F.slice("p", 1, F.greatest(F.lit(0), F.col("n") - need(F.col("n")) + 1 - alone).cast("int"))).alias("i", "e"), alone.alias("alone"))
    posts = Table(posts.select(F.col("e.s").alias("s"), "c", "component", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left")), "open-prefix", rows=8 * n)
    x, y = (posts.df.select("s", F.col("c").alias(c), F.col("component").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.col("left").alias(f"l{c}")) for c in "ab")
    fits = (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & (F.least("la", "lb") * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
    cross = x.join(y, (x.s == y.s) & fits).select("a", "na", "b", "nb").distinct().join(first.df.select("a", "b"), ["a", "b"], "left_anti")
    rest = Table(linked(cross), "links-3", rows=n)
    if rest.df.limit(1).count():
        found.drop()
        found = connected_components(all_links.union(rest.df), n)
    for t in (lists, prefix, heads, first, known, sets, mixed, member, bits, often, posts, links, more, rest):
        t.drop()
    of = classes.df.select(F.col("c").alias("id"), "head").join(found.df, "id")
    tops = Table(of.groupBy("component").agg(F.min("head").alias("top")), "tops", rows=n)
    labels = found.df.join(tops.df.hint("merge"), "component").select(F.col("id").alias("c"), "top")
    ids = classes.df.join(labels, "c", "left").select("lo", "hi", "n", F.coalesce("top", "head").alias("top"))
    out = signed.df.drop("sig").join(ids, ["lo", "hi", "n"], "left")
    alone = F.col("n") == 0
    return out.select("id", "row", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("component_id"), (alone | (F.col("row") == F.col("top.row"))).alias("head"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document at a similarity of 0.85."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.t),
k AS (SELECT s AS doc_id, min(t) AS component_id FROM r GROUP BY s)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
