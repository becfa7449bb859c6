"""Declarations, symbols, imports and references from source text, row by row with regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.functions import languages as L
from loomstack.functions.text import extension, literal_map, trim


def language_of(path: Column) -> Column:
    """Language by special file name, then by extension, else unknown."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]", -1), -1))
    by_ext = {e: row.split(": ")[0] for row in L.EXTENSIONS for e in row.split(": ")[1].split()}
    special = (
        F.when((name == "dockerfile") | name.endswith(".dockerfile"), "dockerfile")
        .when((name == "makefile") | name.endswith(".mk"), "make")
        .when((name == "cmakelists.txt") | name.endswith(".cmake"), "cmake")
    )
    return special.otherwise(F.coalesce(literal_map(by_ext)[extension(path)], F.lit("unknown")))


def patterns() -> dict[str, list[tuple[str, str]]]:
    """language -> (pattern, node type) in order; braces are escaped where they are no quantifier."""
    out: dict[str, list[tuple[str, str]]] = {}
    for row in L.DECLARATIONS:
        lang, p = row.split(" ", 1)
        kind = next((t for w, t, _ in L.TYPE_WORDS if w in p), "function_declaration")
        if "(" in p.replace("(?:", "").replace("(?i)", ""):
            out.setdefault(lang, []).append((re.sub(r"(?<!\\)\{(?!\d)", r"\\{", p), kind))
    return out


def parse_declarations(files: DataFrame, skip_non_code: bool = True) -> DataFrame:
    """(file_path, type, name, start_line, end_line from 0) of lines that declare something.

    The first pattern of the file's language that gives a name counts.  The
    end of functions and classes is where the braces close within 50 lines.
    """
    rows = files.withColumn("language", F.coalesce(F.col("language"), language_of(F.col("file_path"))) if "language" in files.columns else language_of(F.col("file_path")))
    if skip_non_code:
        rows = rows.where(~F.col("language").isin(L.NON_CODE))
    text = F.when(F.col("language") == "vue", vue_script(F.col("content"))).otherwise(F.col("content"))
    rows = rows.select("file_path", "language", F.split(text, "\n", -1).alias("ls"))
    none = F.lit(None).cast("struct<type:string,name:string>")

    def declared(s: Column) -> Column:
        out = none
        for lang, table in reversed(list(patterns().items())):
            def hit(p, kind):
                name = F.regexp_extract(s, p, 1)
                return F.when((name != "") & ~name.isin(L.NOT_NAMES), F.struct(F.lit(kind).alias("type"), name.alias("name")))
            out = F.when(F.col("language") == lang, F.coalesce(*[hit(p, k) for p, k in table])).otherwise(out)
        return out

    braces = lambda s: F.length(F.replace(s, F.lit("}"), F.lit(""))) - F.length(F.replace(s, F.lit("{"), F.lit("")))
    zero = lambda s: F.struct(braces(s).alias("open"), F.lit(0).alias("n"))
    step = lambda a, s: F.when(a["open"] > 0, F.struct((a["open"] + braces(s)).alias("open"), (a["n"] + 1).alias("n"))).otherwise(a)
    found = rows.select("file_path", "ls", F.posexplode(F.transform("ls", lambda s: declared(trim(s)))).alias("i", "d")).where("d is not null")
    body = F.aggregate(F.slice("ls", F.col("i") + 2, 49), zero(trim(F.get("ls", F.col("i")))), step, lambda a: a["n"])
    end = F.when(F.col("d.type").rlike("function|class"), F.col("i") + body).otherwise(F.col("i"))
    return found.select("file_path", "d.type", "d.name", F.col("i").alias("start_line"), end.alias("end_line"))


def vue_script(content: Column) -> Column:
    """The first script section with content that is not a setup one, else the first setup one."""
    tags = F.regexp_extract_all(content, F.lit(r"(?s)<script([^>]*)>.*?</script>"), F.lit(1))
    bodies = F.regexp_extract_all(content, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    both = F.arrays_zip(tags.alias("t"), bodies.alias("b"))
    full = F.filter(both, lambda x: trim(x["b"]) != "")
    plain = F.filter(full, lambda x: ~x["t"].rlike(r"(?<![A-Za-z])setup(?![A-Za-z])"))
    return F.coalesce(F.get(plain, 0)["b"], F.get(full, 0)["b"], F.lit(""))


def symbols(declarations: DataFrame, most: int | None = 500) -> DataFrame:
    """(id, name, kind, file_path, start_line, end_line): names that are words of 2 to 100 characters, ``most`` a file."""
    kind = literal_map({t: k for _, t, k in L.TYPE_WORDS})[F.col("type")]
    good = (F.length("name").between(2, 100)) & ~F.lower("name").isin(L.NOISE_NAMES) & ~F.col("name").rlike(r"^[\d_$]+\z")
    rows = declarations.where(good).select(F.concat_ws(":", "file_path", "name", F.col("start_line").cast("string")).alias("id"), "name", kind.alias("kind"), "file_path", "start_line", "end_line").dropDuplicates(["id"])
    if most is None:
        return rows
    return rows.withColumn("r", F.row_number().over(W.partitionBy("file_path").orderBy("start_line", "name"))).where(F.col("r") <= most).drop("r")


def imports(files: DataFrame) -> DataFrame:
    """(file_path, source) of import ... from, bare imports and require calls."""
    p = r"""(?:import\s+(?:[^'"`;]*?\s+from\s+)?|require\s*\(\s*|import\s*\(\s*)['"]([^'"]+)['"]"""
    return files.select("file_path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("source"))


def references(files: DataFrame, syms: DataFrame) -> DataFrame:
    """(symbol_id, file_path, line, kind): identifiers that equal a symbol's name, by hash join."""
    rows = files.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("i", "s"))
    words = rows.select("file_path", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("s", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*\s*(?:\(|=(?!=)|:)?)"), F.lit(1))).alias("w"))
    name, tail = F.regexp_extract("w", r"^([A-Za-z_$][A-Za-z0-9_$]*)", 1), F.substring(F.col("w"), -1, 1)
    kind = F.when(tail == "(", "call").when(tail == "=", "write").when(tail == ":", "type").otherwise("read")
    return words.select("file_path", "line", name.alias("name"), kind.alias("kind")).join(syms.select(F.col("id").alias("symbol_id"), "name"), "name").select("symbol_id", "file_path", "line", "kind")


def symbol_statistics(syms: DataFrame) -> DataFrame:
    return syms.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
