"""Column helpers with the string semantics the operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Without ASCII blanks, tabs and line ends on either side (``trim`` alone strips spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rounded(c: Column, digits: int = 0) -> Column:
    """Half up on the binary value, as floor(x * 10^d + 0.5) / 10^d."""
    if not digits:
        return F.floor(c + 0.5).cast("double")
    p = F.lit(float(10**digits))
    return F.floor(c * p + 0.5) / p


def bounded(pattern: str) -> str:
    """``pattern`` as a whole word of ASCII word characters."""
    return rf"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(file_path, line_no from 1, line, trimmed) for every line."""
    rows = files.select("file_path", F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), "\n", -1)).alias("i", "line"))
    return rows.select("file_path", (F.col("i") + 1).alias("line_no"), "line", trim(F.col("line")).alias("trimmed"))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def matches(content: Column, pattern: str) -> Column:
    """Array of (line, offset, text) of a pattern's matches: what lies between matches and the matches add up to the text."""
    gaps, hits = F.split(content, pattern, -1), F.regexp_extract_all(content, F.lit(pattern), F.lit(0))

    def upto(i: Column, size) -> Column:
        add = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + size(x))
        return add(gaps, i + 1) + F.when(i > 0, add(hits, i)).otherwise(0)

    found = F.transform(hits, lambda h, i: F.struct((upto(i, newlines) + 1).alias("line"), upto(i, F.length).alias("offset"), h.alias("text")))
    none = F.array().cast("array<struct<line:int,offset:int,text:string>>")
    return F.when(content.rlike(pattern), found).otherwise(none)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
