"""Clones: repeated windows of lines, and maximal repeated runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.functions.storage import Table
from loomstack.functions.text import rounded, trim

WINDOWS, LEAST_CHARS, LINE_CHARS, RUN_CHARS, LEAST_LINES = (6, 10, 15, 25), 20, 10, 3, 6


def normalized(line: Column) -> Column:
    """A line without comment, with empty strings and single blanks."""
    s = F.regexp_replace(line, "//.*$", "")
    s = F.regexp_replace(s, "['\"`][^'\"`]*['\"`]", '""')
    return trim(F.regexp_replace(s, r"\s+", " "))


def clone_windows(files: DataFrame, sizes: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(block, size, file_path, start_line) of every window whose normalised text occurs twice, overlaps in a file dropped.

    Blocks are keyed by a 256-bit digest of the text.  A block in one file only
    counts if two of its windows are more than twice the size apart.
    """
    norm = F.transform(F.split("content", "\n", -1), normalized)
    base = files.select("file_path", norm.alias("ls"))

    def of(w: int) -> DataFrame:
        starts = F.when(F.size("ls") >= w, F.sequence(F.lit(1), F.size("ls") - (w - 1))).otherwise(F.array().cast("array<int>"))
        rows = base.select("file_path", F.explode(F.transform(starts, lambda i: F.struct(i.alias("start_line"), F.array_join(F.filter(F.slice("ls", i, w), lambda s: s != ""), "\n").alias("t")))).alias("b"))
        return rows.where(F.length("b.t") >= LEAST_CHARS).select(F.sha2("b.t", 256).alias("block"), F.lit(w).alias("size"), "file_path", "b.start_line")

    rows = reduce(DataFrame.unionAll, [of(w) for w in sizes])
    again = rows.groupBy("block", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block", "size")
    starts = rows.join(again, ["block", "size"]).groupBy("block", "size", "file_path").agg(F.sort_array(F.collect_list("start_line")).alias("s"))
    zero = F.struct((-F.col("size")).alias("end"), F.array().cast("array<int>").alias("kept"))
    fold = lambda a, x: F.when(x > a["end"], F.struct((x + F.col("size")).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    kept = starts.withColumn("s", F.aggregate("s", zero, fold, lambda a: a["kept"]))
    far = F.exists(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: (i < F.size("s")) & (F.get("s", i) - F.get("s", i - 1) > 2 * F.col("size"))), lambda x: x)
    groups = kept.groupBy("block", "size").agg(F.sum(F.size("s")).alias("n"), F.count(F.lit(1)).alias("files"), F.bool_or(far).alias("far")).where("n > 1 AND (files > 1 OR far)").select("block", "size")
    return kept.join(groups, ["block", "size"]).select("block", "size", "file_path", F.explode("s").alias("start_line"))


def clone_runs(files: DataFrame) -> DataFrame:
    """(file1, line1, file2, line2, n) of maximal equal runs between a file and the first file with the run's first line.

    Each line is held against its first occurrence in another file, not
    against all, so a frequent line gives one row for each place; runs that
    other files share, and short lines in a run, are lost to this form, and
    ``clone_pair_runs`` has them.
    """
    rows = files.select("file_path", F.posexplode(F.transform(F.split("content", "\n", -1), normalized)).alias("i", "s")).where(F.length("s") >= LINE_CHARS)
    rows = rows.select("file_path", (F.col("i") + 1).alias("line"), F.sha2("s", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min(F.struct("file_path", "line")).alias("f"), F.min("file_path").alias("a"), F.max("file_path").alias("b")).where("a <> b")
    pairs = rows.join(first, "h").where(F.col("file_path") != F.col("f.file_path")).select(F.col("f.file_path").alias("file1"), F.col("f.line").alias("line1"), F.col("file_path").alias("file2"), F.col("line").alias("line2"))
    lane = W.partitionBy("file1", "file2", F.col("line2") - F.col("line1")).orderBy("line2")
    runs = pairs.withColumn("d", F.col("line2") - F.col("line1")).withColumn("island", F.col("line2") - F.row_number().over(lane))
    out = runs.groupBy("file1", "file2", "d", "island").agg(F.min("line1").alias("line1"), F.min("line2").alias("line2"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= LEAST_LINES).select("file1", "line1", "file2", "line2", "n")


def clone_pair_runs(files: DataFrame) -> DataFrame:
    """(file1, line1, file2, line2, n) of maximal equal runs of every two files, file1 < file2.

    A run starts at a line of ``LINE_CHARS`` and goes on through lines of
    ``RUN_CHARS``.  Equal windows of ``LEAST_LINES`` lines are joined, and of
    each run only its first and last window and those where longer lines begin
    leave the join.  The result has a row for each pair of copies, so it grows
    with the square of how often a passage is copied.
    """
    ls = F.transform(F.split("content", "\n", -1), normalized)
    window = lambda i: F.slice("ls", i, LEAST_LINES)
    key = lambda i: F.when(F.forall(window(i), lambda s: F.length(s) >= RUN_CHARS), F.unhex(F.sha2(F.array_join(window(i), "\n"), 256)))
    starts = F.when(F.size("ls") >= LEAST_LINES, F.sequence(F.lit(1), F.size("ls") - (LEAST_LINES - 1))).otherwise(F.array().cast("array<int>"))
    base = files.select("file_path", ls.alias("ls")).withColumn("keys", F.transform(starts, key))
    near = lambda i: F.struct((i + 1).alias("line"), F.get("keys", i).alias("key"), F.when(i > 0, F.get("keys", i - 1)).alias("before"), F.get("keys", i + 1).alias("after"), (F.length(F.get("ls", i)) >= LINE_CHARS).alias("long"), F.when(i > 0, F.length(F.get("ls", i - 1)) >= LINE_CHARS).alias("was"))
    rows = base.select("file_path", F.explode(F.transform(starts, lambda i: near(i - 1))).alias("w")).select("file_path", "w.*").where("key IS NOT NULL")
    shared = rows.groupBy("key").agg(F.min("file_path").alias("a"), F.max("file_path").alias("b")).where("a <> b").select("key")
    table = Table(rows.join(shared, "key", "left_semi"), "windows").df
    a, b = table.alias("a"), table.alias("b")
    first, last = ~F.coalesce(F.col("a.before") == F.col("b.before"), F.lit(False)), ~F.coalesce(F.col("a.after") == F.col("b.after"), F.lit(False))
    seed = F.col("b.long") & (first | ~F.col("b.was"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.file_path") < F.col("b.file_path")) & (first | last | seed))
    line = F.col("b.line")
    marks = pairs.groupBy(F.col("a.file_path").alias("file1"), F.col("b.file_path").alias("file2"), (line - F.col("a.line")).alias("d")).agg(*[F.sort_array(F.collect_list(F.when(c, line))).alias(n) for n, c in (("first", first), ("last", last), ("seed", seed))])
    runs = marks.select("file1", "file2", "d", "seed", F.explode(F.arrays_zip("first", "last")).alias("r"))
    runs = runs.withColumn("line2", F.array_min(F.filter("seed", lambda x: (x >= F.col("r.first")) & (x <= F.col("r.last"))))).where("line2 IS NOT NULL")
    return runs.select("file1", (F.col("line2") - F.col("d")).alias("line1"), "file2", "line2", (F.col("r.last") - F.col("line2") + LEAST_LINES).cast("long").alias("n"))


def top_clones(windows: DataFrame, limit: int = 50, shown: int = 5) -> DataFrame:
    """The largest clones of which no shown line is covered by a larger one.

    The greedy choice is sequential and meets the blocks in order of size and
    block, ``limit`` x 40 at a time; blocks that the chosen lines cover do not
    come again, so it ends with ``limit`` clones or the last block.
    """
    spark = windows.sparkSession
    groups = windows.groupBy("block", "size").agg(F.slice(F.sort_array(F.collect_list(F.struct("file_path", "start_line"))), 1, shown).alias("instances"))
    groups = Table(groups, "clones")
    covered, keep, left = set(), [], groups.df
    while head := left.orderBy(F.desc("size"), "block").limit(40 * limit).collect():
        for r in head:
            lines = {(i.file_path, i.start_line + k) for i in r.instances for k in range(r["size"])}
            if len(keep) < limit and not lines & covered:
                covered |= lines
                keep.append(r)
        if len(keep) == limit or len(head) < 40 * limit:
            break
        taken = spark.createDataFrame([([(i.file_path, i.start_line, i.start_line + r["size"]) for r in keep for i in r.instances],)], "taken array<struct<file:string,first:int,stop:int>>")
        meets = lambda i: F.exists("taken", lambda t: (t["file"] == i["file_path"]) & (t["first"] < i["start_line"] + F.col("size")) & (i["start_line"] < t["stop"]))
        last = head[-1]
        after = (F.col("size") < last["size"]) | ((F.col("size") == last["size"]) & (F.col("block") > last["block"]))
        left = groups.df.where(after).crossJoin(F.broadcast(taken)).where(~F.exists("instances", meets)).drop("taken")
    groups.drop()
    return spark.createDataFrame([(r["block"], r["size"], r["instances"]) for r in keep], "block string, size int, instances array<struct<file_path:string,start_line:int>>")


def duplication_summary(windows: DataFrame) -> DataFrame:
    """Clones, distinct duplicated lines, files affected and hours."""
    groups = windows.groupBy("block", "size").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("clones"), F.coalesce(F.sum(F.lit(0.25) + F.col("n") * 0.08), F.lit(0.0)).alias("h"))
    covered = windows.select("file_path", F.explode(F.sequence("start_line", F.col("start_line") + F.col("size") - 1)).alias("line")).distinct()
    lines = covered.agg(F.count(F.lit(1)).alias("duplicated_lines"), F.count_distinct("file_path").alias("files_affected"))
    return groups.crossJoin(lines).select("clones", "duplicated_lines", "files_affected", rounded(F.col("h"), 1).alias("hours"))
