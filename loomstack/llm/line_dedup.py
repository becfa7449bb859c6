"""Line dedup: a suffix array over sequences of line IDs, by prefix doubling.

A document is the sequence of its lines that have a word; equal lines (128-bit
hash) have one ID.  Prefix doubling sorts the suffixes by their first 1, 2,
4, ... lines: a level's rank of a suffix is the place of (rank of its first
half, rank of its second half) in the sorted order of all such pairs.  Pairs
are first counted, so the sort sees one row for each distinct pair, dealt by
range; suffixes that are alone drop out.  Suffixes of equal rank are the
interval of a longest common prefix of at least that many lines.  An interval
of any other depth is that of two overlapping runs of a power of two.

A line is deleted if it lies in a run of at least ``min_words`` words that also
starts earlier (smaller id, or the same document and an earlier line).  Every
line of a maximal repeated run of enough words lies in one of the shortest
runs of enough words that start, or end, at a line of it, and these have at
most ``min_words`` lines.  So intervals of a depth of ``min_words`` lines reveal
the maximal runs whole, as unions, and doubling ends there.

Tables of places and ranks compress to far less than they are in memory, so
joins with them are told to sort and merge, never to broadcast by file size.

Edge cases: null and empty texts have no lines and stay as they are; lines
without a word are neither matched nor deleted; lines are compared exactly;
repeated rows count as later copies; null ids come first; columns named like
results are replaced; texts are read whole; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.llm.common import WORD_RE, Table, replace_columns

MIN_WORDS = 10


def _place() -> Column:
    return F.struct("id", "uid", "line")


def _ranked(rows: DataFrame, key: list[str], tag: str, most: int) -> Table:
    """Rows whose key repeats, with its ``rank``: numbers of the partitions of a range sort, in order, and of the keys in each."""
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # A table, not an aggregate, so that Spark can split the places of a frequent key over tasks.
    order = Table(repeated.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id()), f"{tag}-order", most)
    out = Table(rows.join(order.df.hint("merge"), key).drop(*key), tag, most)
    order.drop()
    return out


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, gone): for documents (uid, id, text) the numbers of the lines to delete, from 0."""
    # About one line for 32 bytes of text.
    most = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 32
    parts = docs.select("uid", "id", F.posexplode(F.split("text", "\n", -1)).alias("no", "s")).where(F.col("s").rlike(WORD_RE))
    words = F.regexp_count("s", F.lit(WORD_RE)).cast("int")
    plain = parts.select("uid", "id", "no", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), words.alias("words"))
    by_doc = W.partitionBy("uid").orderBy("no")
    lines = plain.withColumn("line", F.row_number().over(by_doc)).withColumn("upto", F.sum("words").over(by_doc))
    levels = [_ranked(lines, ["h1", "h2"], "lines-0", most)]
    base = levels[0].df
    step = 1
    while step * 2 <= min_words:
        low = levels[-1].df
        half = low.select("uid", (F.col("line") - step).alias("line"), F.col("rank").alias("r2"))
        pairs = low.select("uid", "id", "line", F.col("rank").alias("r1")).join(half.hint("merge"), ["uid", "line"])
        levels.append(_ranked(pairs, ["r1", "r2"], f"lines-{2 * step}", most))
        step *= 2
    # The shortest runs of enough words that start, or end, at a line; only lines that repeat can be in one.
    island = F.col("line") - F.row_number().over(W.partitionBy("uid").orderBy("line"))
    live = base.select("uid", "id", "line", "no", "words", "upto").withColumn("island", island)
    near = W.partitionBy("uid", "island").orderBy("line")
    ahead = F.collect_list(F.struct("line", "upto")).over(near.rowsBetween(0, min_words - 1))
    behind = F.collect_list(F.struct("line", (F.col("upto") - F.col("words")).alias("before"))).over(near.rowsBetween(-(min_words - 1), 0))
    reach = live.withColumn("a", ahead).withColumn("b", behind)
    last = F.array_min(F.transform(F.filter("a", lambda x: x["upto"] - F.col("upto") + F.col("words") >= min_words), lambda x: x["line"]))
    start = F.array_max(F.transform(F.filter("b", lambda x: F.col("upto") - x["before"] >= min_words), lambda x: x["line"]))
    spans = reach.select("uid", "id", "line", last.alias("last"), start.alias("start"))
    runs = spans.where("last is not null").select("uid", "id", "line", (F.col("last") - F.col("line") + 1).alias("n")).union(spans.where("start is not null").select("uid", "id", F.col("start").alias("line"), (F.col("line") - F.col("start") + 1).alias("n"))).distinct()
    runs = Table(runs, "runs", most)
    hits, firsts = None, []
    for k, level in enumerate(levels):
        size = 1 << k
        mine = runs.df.where((F.col("n") >= size) & (F.col("n") < 2 * size))
        name = level.df.select("uid", "line", F.col("rank").alias("r1"))
        tail = name.select("uid", F.col("line").alias("tail"), F.col("r1").alias("r2"))
        both = mine.join(name.hint("merge"), ["uid", "line"]).withColumn("tail", F.col("line") + F.col("n") - size).join(tail.hint("merge"), ["uid", "tail"])
        key = ["n", "r1", "r2"]
        first = both.groupBy(*key).agg(F.min(_place()).alias("f"), F.count(F.lit(1)).alias("m")).where("m > 1").select(*key, F.col("f.uid").alias("ou"), F.col("f.line").alias("ol"))
        firsts.append(Table(first, "runs-first", most))
        again = both.join(firsts[-1].df.hint("merge"), key).where((F.col("uid") != F.col("ou")) | (F.col("line") != F.col("ol"))).select("uid", "line", "n")
        hits = again if hits is None else hits.union(again)
    gone = hits.select("uid", F.explode(F.sequence("line", F.col("line") + F.col("n") - 1)).alias("line")).distinct()
    numbers = gone.join(base.select("uid", "line", "no").hint("merge"), ["uid", "line"]).groupBy("uid").agg(F.sort_array(F.collect_list("no")).alias("gone"))
    out = Table(numbers, "gone", most)
    for t in (*levels, runs, *firsts):
        t.drop()
    return out.df


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs removed from ``text``, and n_lines, n_removed, n_runs.

    n_lines counts all lines; n_runs the maximal removed runs of adjacent line numbers.
    """
    results = ["n_lines", "n_removed", "n_runs"]
    base = Table(replace_columns(docs, results).withColumn("__uid", F.monotonically_increasing_id()), "line-docs").df
    gone = repeated_lines(base.select(F.col("__uid").alias("uid"), F.col(id_col).alias("id"), F.col(text).alias("text")), min_words)
    full = base.join(gone.withColumnRenamed("uid", "__uid").withColumnRenamed("gone", "__gone").hint("merge"), "__uid", "left")
    parts, g = F.split(F.col(text), "\n", -1), F.col("__gone")
    stay = lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), g), lambda i: F.get(p, i)), "\n")
    left = F.transform(F.array(parts), stay)[0]
    runs = F.size(F.filter(g, lambda x, i: (i == 0) | (F.get(g, i - 1) != x - 1)))
    out = full.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"))
    out = out.withColumn("n_removed", F.when(g.isNull(), 0).otherwise(F.size(g)).cast("long")).withColumn("n_runs", F.when(g.isNull(), 0).otherwise(runs).cast("long"))
    return out.withColumn(text, F.when(g.isNull(), F.col(text)).otherwise(left)).drop("__gone", "__uid")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document, and a digest of what is left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, no, ls[no] AS s, len(regexp_extract_all(ls[no], '[^\x20\x09-\x0D]+')) AS w FROM a, unnest(range(1, len(ls) + 1)) AS r(no)),
d AS (SELECT doc_id, no, s, w, row_number() OVER o AS i, sum(w) OVER o AS c FROM l WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
q AS (SELECT doc_id, list(s ORDER BY i) AS ss FROM d GROUP BY doc_id),
f AS (SELECT x.doc_id, x.i AS b, min(y.i) AS e FROM d x JOIN d y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i AND x.i + 9 AND y.c - x.c + x.w >= 10 GROUP BY 1, 2
      UNION SELECT y.doc_id, max(x.i), y.i FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.i BETWEEN y.i - 9 AND y.i AND y.c - x.c + x.w >= 10 GROUP BY 1, 3),
g AS (SELECT doc_id, b, e, array_to_string(ss[b:e], chr(10)) AS t FROM f JOIN q USING (doc_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, b) AS k FROM g),
x AS (SELECT DISTINCT doc_id, j AS i FROM h, unnest(range(b, e + 1)) AS r(j) WHERE k > 1),
z AS (SELECT d.doc_id, d.no FROM x JOIN d USING (doc_id, i)),
y AS (SELECT doc_id, list(no ORDER BY no) AS gone, count(*) AS n, count(*) FILTER (WHERE fresh) AS runs
      FROM (SELECT *, coalesce(no - lag(no) OVER (PARTITION BY doc_id ORDER BY no) <> 1, true) AS fresh FROM z) GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_runs,
  sha256(CASE WHEN gone IS NULL THEN coalesce(t.text, '') ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda k: NOT list_contains(gone, k)), lambda k: ls[k]), chr(10)), '') END) AS kept_sha256
FROM documents t LEFT JOIN a USING (doc_id) LEFT JOIN y USING (doc_id)
"""
