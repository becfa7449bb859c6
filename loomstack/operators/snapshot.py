"""Content hashes, snapshots, diffs, Merkle hashes and folder counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.functions.storage import Table


def content_hash(content: Column) -> Column:
    """The first 16 hex digits of SHA-256 as an unsigned decimal string; "0" for an empty content."""
    return F.when(F.length(content) == 0, "0").otherwise(F.conv(F.substring(F.sha2(content.cast("binary"), 256), 1, 16), 16, 10))


def snapshot(files: DataFrame) -> DataFrame:
    """(path, content_hash, size) of files."""
    c = F.coalesce(F.col("content"), F.lit(""))
    return files.select(F.col("file_path").alias("path"), content_hash(c).alias("content_hash"), F.octet_length(c).cast("long").alias("size"))


def diff(old: DataFrame, new: DataFrame, renames: bool = True) -> DataFrame:
    """(type, path, old_path) of what was added, modified, deleted or renamed.

    A rename pairs a path that is gone with a new one of equal non-zero hash,
    one to one in the order of paths.
    """
    a, b = old.select("path", F.col("content_hash").alias("h0")), new.select("path", F.col("content_hash").alias("h1"))
    both = a.join(b, "path", "full")
    gone, came = both.where("h1 is null"), both.where("h0 is null")
    rank = lambda h: F.row_number().over(W.partitionBy(h).orderBy("path"))
    x = gone.where("h0 <> '0'").select(F.col("h0").alias("h"), rank("h0").alias("k"), F.col("path").alias("old_path"))
    y = came.where("h1 <> '0'").select(F.col("h1").alias("h"), rank("h1").alias("k"), "path")
    moved = x.join(y, ["h", "k"]).select("path", "old_path")
    none = F.lit(None).cast("string").alias("old_path")
    out = both.where("h0 <> h1").select(F.lit("modified").alias("type"), "path", none)
    if renames:
        out = out.union(moved.select(F.lit("renamed"), "path", "old_path"))
        gone = gone.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
        came = came.join(moved.select("path"), "path", "left_anti")
    return out.union(came.select(F.lit("added"), "path", none)).union(gone.select(F.lit("deleted"), "path", none))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _parents(path: Column) -> Column:
    """All folders above a path, the root as an empty string."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def folder_counts(snap: DataFrame) -> DataFrame:
    """(folder, files, size) with everything below each folder."""
    return snap.select(F.explode(_parents(F.col("path"))).alias("folder"), "size").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))


def flat_root_hash(snap: DataFrame) -> DataFrame:
    """One hash of all file hashes, sorted: digests of ranges of hashes first, then the digest of those."""
    part = snap.groupBy(F.substring("content_hash", 1, 2).alias("p")).agg(content_hash(F.array_join(F.sort_array(F.collect_list("content_hash")), "")).alias("h"))
    return part.agg(content_hash(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "")).alias("root_hash"))


def _folded(files: DataFrame, digest) -> DataFrame:
    """(path, hash) of files (path, hash, depth) and of all folders, from the deepest up; each level is stored, as both the next one and the result read it."""
    deepest, n = files.agg(F.max("depth"), F.count(F.lit(1))).first()
    deepest = deepest or 0
    parent = F.regexp_replace("path", r"/?[^/]*\z", "")
    done, folders = files.select("path", "hash"), None
    for d in range(deepest, 0, -1):
        level = files.where(F.col("depth") == d).select("path", "hash")
        if folders is not None:
            level = level.union(folders)
        children = F.transform(F.sort_array(F.collect_list(F.struct("path", "hash"))), lambda x: x["hash"])
        up = level.groupBy(parent.alias("parent")).agg(digest(children).alias("hash")).select(F.col("parent").alias("path"), "hash")
        folders = Table(up, "merkle", n).df
        done = done.union(folders)
    return done


def merkle(snap: DataFrame) -> DataFrame:
    """(path, hash) of every file and folder: a folder's hash is the digest of its children's in the order of names."""
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/", -1)))
    return _folded(snap.select("path", F.col("content_hash").alias("hash"), depth.alias("depth")), lambda xs: F.sha2(F.array_join(xs, ","), 256))


_LOW = (1 << 32) - 1


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2**64 on signed longs, in halves so that nothing overflows."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def combine(h1: Column, h2: Column) -> Column:
    """h1 xor (h2 + constant + h1 shifted left by 6 + h1 shifted right by 2), modulo 2**64."""
    return h1.bitwiseXOR(add64(add64(h2, F.lit(0x9E3779B185EBCA87 - (1 << 64))), add64(F.shiftleft(h1, 6), F.shiftrightunsigned(h1, 2))))


def merkle_combined(snap: DataFrame) -> DataFrame:
    """(path, hash): as ``merkle``, a folder's hash being the fold of ``combine`` over its children's; unsigned decimal."""
    files = snap.select("path", F.conv("content_hash", 10, -10).cast("long").alias("hash"), F.size(F.split("path", "/", -1)).alias("depth"))
    done = _folded(files, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), combine))
    return done.select("path", F.conv(F.col("hash").cast("string"), 10, 10).alias("hash"))


def merkle_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose Merkle hash differs or that only one side has."""
    both = old.withColumnRenamed("hash", "h0").join(new.withColumnRenamed("hash", "h1"), "path", "full")
    return both.where(~F.col("h0").eqNullSafe(F.col("h1"))).select("path")


class FileIndex:
    """A snapshot table with add, remove, get and save; each method gives a new index."""

    def __init__(self, snap: DataFrame):
        self.df = snap

    def add(self, rows: DataFrame) -> FileIndex:
        return FileIndex(self.df.join(rows.select("path"), "path", "left_anti").unionByName(rows.select(*self.df.columns)))

    def remove(self, paths: DataFrame) -> FileIndex:
        return FileIndex(self.df.join(paths.select("path"), "path", "left_anti"))

    def get(self, path: str) -> DataFrame:
        return self.df.where(F.col("path") == path)

    def size(self) -> int:
        return self.df.count()

    def save(self, folder: str) -> None:
        self.df.write.mode("overwrite").parquet(folder)

    @staticmethod
    def load(spark, folder: str) -> FileIndex:
        return FileIndex(spark.read.parquet(folder))
