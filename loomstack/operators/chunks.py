"""Token estimates and chunks of source text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.operators.parse import parse_declarations

MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS = 512, 64, 50
_RUNS = r"[ \t]+|[\r\n]|[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*|[0-9][0-9.]*|[\s\S]"


def count_tokens(text: Column) -> Column:
    """Estimated tokens: a run of blanks, a line end or a sign 1; words by length in fours; numbers by length in threes."""

    def size(run: Column) -> Column:
        n = F.length(run)
        return F.when(run.rlike(r"^[A-Za-z_\x{80}-\x{10FFFF}]"), F.ceil(n / 4)).when(run.rlike(r"^[0-9]"), F.ceil(n / 3)).otherwise(1).cast("int")

    return F.aggregate(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RUNS), F.lit(0)), F.lit(0), lambda a, r: a + size(r))


def sliding_chunks(files: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(file_path, chunk, start_line, end_line, tokens, content): lines up to ``most`` tokens, each chunk after the first
    begins with lines of at least ``overlap`` tokens before it; a last chunk under ``least`` tokens is dropped.

    A fold over the lines of one file; only line numbers are carried along.
    """
    rows = F.split("content", "\n", -1)
    sizes = F.transform(rows, lambda s: count_tokens(F.concat(s, F.lit("\n"))))
    base = files.select("file_path", rows.alias("ls"), sizes.alias("ts"))
    kind = "array<struct<start:int,end:int,tokens:int>>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("tokens"), F.array().cast(kind).alias("out"))
    back0 = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))

    def step(a: Column, t: Column) -> Column:
        full = (a["tokens"] + t > most) & (a["tokens"] > 0)
        # The last lines before this one, nearest first; no more than the overlap's tokens can be needed.
        near = F.reverse(F.slice("ts", F.greatest(a["i"] - overlap + 1, F.lit(1)), F.least(a["i"], F.lit(overlap))))
        back = F.aggregate(near, back0, lambda b, x: F.when(b["sum"] < overlap, F.struct((b["n"] + 1).alias("n"), (b["sum"] + x).alias("sum"))).otherwise(b))
        cut = F.array(F.struct(a["start"].alias("start"), (a["i"] - 1).alias("end"), a["tokens"].alias("tokens")))
        fresh = F.struct((a["i"] + 1).alias("i"), (a["i"] - back["n"]).alias("start"), (back["sum"] + t).alias("tokens"), F.concat(a["out"], cut).alias("out"))
        same = F.struct((a["i"] + 1).alias("i"), a["start"].alias("start"), (a["tokens"] + t).alias("tokens"), a["out"].alias("out"))
        return F.when(full, fresh).otherwise(same)

    def done(a: Column) -> Column:
        last = F.array(F.struct(a["start"].alias("start"), (a["i"] - 1).alias("end"), a["tokens"].alias("tokens")))
        return F.when(a["tokens"] >= least, F.concat(a["out"], last)).otherwise(a["out"])

    cuts = base.select("file_path", "ls", F.aggregate("ts", zero, step, done).alias("cuts"))
    text = lambda ls, c: F.concat(F.array_join(F.slice(ls, c["start"] + 1, c["end"] - c["start"] + 1), "\n"), F.lit("\n"))
    pieces = pieces_of("cuts", lambda ls, c: F.struct((c["start"] + 1).alias("start_line"), (c["end"] + 1).alias("end_line"), c["tokens"].alias("tokens"), text(ls, c).alias("content")))
    return cuts.select("file_path", F.posexplode(pieces).alias("chunk", "c")).select("file_path", "chunk", "c.*")


def pieces_of(cuts: str, piece) -> Column:
    """``piece`` of the lines and of each cut, made inside the array so that no row carries all lines of its file."""
    both = F.struct(F.col("ls").alias("ls"), F.col(cuts).alias("cuts"))
    return F.flatten(F.transform(F.array(both), lambda x: F.transform(x["cuts"], lambda c: piece(x["ls"], c))))


#: Lines that begin a logical block, by language; other languages break on braces.
BOUNDARIES = {
    "javascript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const\s+\w+\s*=\s*(?:async\s*)?\()",
    "typescript": r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|enum|type\s+\w+\s*=|const\s+\w+\s*=\s*(?:async\s*)?\()",
    "python": r"^(?:async\s+)?(?:def|class)\s+\w+",
    "go": r"^(?:func|type)\s+",
    "rust": r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl|mod)[\s<]",
    "java": r"^\s{0,4}(?:public|private|protected)\s+.*[({]\s*\z",
    "php": r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*(?:function|class|interface|trait)\s+\w+",
    "ruby": r"^\s*(?:def|class|module)\s+\w+",
    "csharp": r"^\s*(?:public|private|protected|internal)\s+.*[({]\s*\z",
}


def logical_chunks(files: DataFrame, most_chars: int = 4000) -> DataFrame:
    """(file_path, chunk, start_line, end_line, name): a small file whole, a larger one cut before each block and after ``most_chars``."""
    rows = F.split("content", "\n", -1)
    kind = "array<struct<start:int,end:int>>"

    def opens(s: Column) -> Column:
        out = s.rlike(r"\{\s*\z")
        for lang, p in BOUNDARIES.items():
            out = F.when(F.col("language") == lang, s.rlike(p)).otherwise(out)
        return out

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("chars"), F.array().cast(kind).alias("out"))

    def step(a: Column, s: Column) -> Column:
        n = F.length(s) + 1
        cut = (a["i"] > a["start"]) & (opens(s) | (a["chars"] + n > most_chars))
        piece = F.array(F.struct(a["start"].alias("start"), (a["i"] - 1).alias("end")))
        return F.struct((a["i"] + 1).alias("i"), F.when(cut, a["i"]).otherwise(a["start"]).alias("start"), F.when(cut, n).otherwise(a["chars"] + n).alias("chars"), F.when(cut, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    last = lambda a: F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), (a["i"] - 1).alias("end"))))
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.size(rows) - 1).alias("end")))
    cuts = files.select("file_path", rows.alias("ls"), F.when(F.length("content") <= most_chars, whole).otherwise(F.aggregate(rows, zero, step, last)).alias("cuts"))
    name = lambda ls, c: F.regexp_extract(F.get(ls, c["start"]), r"(?:function|class|def|interface|enum|type|const|func|fn|struct|trait|impl|module)\s+(\w+)", 1)
    pieces = pieces_of("cuts", lambda ls, c: F.struct((c["start"] + 1).alias("start_line"), (c["end"] + 1).alias("end_line"), name(ls, c).alias("name")))
    return cuts.select("file_path", F.posexplode(pieces).alias("chunk", "c")).select("file_path", "chunk", "c.*")


# --- the byte-based estimate, boundaries and chunks along them ------------------

_BYTE_RUNS = r"[ \t\x0b\f]+|[\r\n]|[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*|[0-9][0-9.eExX+\-a-fA-F]*|(?:==|!=|<=|>=|&&|\|\||=>|->|::|\+\+|--|\+=|-=|\*=|/=)=?|[\s\S]"


def _runs(text: Column) -> Column:
    """(size in tokens, characters) of each run of the byte-based estimate."""

    def one(run: Column) -> Column:
        n = F.octet_length(run)
        size = F.when(run.rlike(r"^[A-Za-z_\x{80}-\x{10FFFF}]"), F.ceil(n / 4)).when(run.rlike(r"^[0-9]"), F.ceil(n / 3)).otherwise(1).cast("int")
        return F.struct(size.alias("n"), F.length(run).alias("chars"))

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_BYTE_RUNS), F.lit(0)), one)


def count_tokens_bytes(text: Column) -> Column:
    """As ``count_tokens``, with words measured in bytes, operators of two or three signs as one, and hex and exponents in numbers."""
    return F.aggregate(_runs(text), F.lit(0), lambda a, r: a + r["n"])


def encode(text: Column) -> Column:
    """Numbers 0, 1, ... for the tokens of a text; there is no vocabulary."""
    n = count_tokens_bytes(text)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def token_boundary(text: Column, most: int) -> Column:
    """Characters of the longest beginning of whole runs that has at most ``most`` tokens."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("on"))

    def step(a: Column, r: Column) -> Column:
        on = a["on"] & (a["n"] + r["n"] <= most)
        return F.struct(F.when(on, a["n"] + r["n"]).otherwise(a["n"]).alias("n"), F.when(on, a["chars"] + r["chars"]).otherwise(a["chars"]).alias("chars"), on.alias("on"))

    return F.aggregate(_runs(text), zero, step, lambda a: a["chars"])


def _fnv1a64(texts: pa.Array) -> pa.Array:
    """One step for the k-th byte of all texts at a time, the longest texts first."""
    raw = [t.encode() for t in texts.to_pylist()]
    order = np.argsort([-len(r) for r in raw], kind="stable")
    size = np.array([len(raw[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        h[:n] = (h[:n] ^ data[start[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty(len(raw), object)
    out[order] = [str(x) for x in h]
    return pa.array(out.tolist(), pa.string())


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as an unsigned decimal string (no built-in form: 64-bit products overflow)."""

    def hashes(texts: pa.Array) -> pa.Array:
        return _fnv1a64(texts)

    hashes.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(hashes, "string")(F.coalesce(text, F.lit("")))


def boundaries(files: DataFrame) -> DataFrame:
    """(file_path, line, type, name, depth): lines that begin a declaration or an import, with the depth of braces before them."""
    found = parse_declarations(files).select("file_path", F.col("start_line").alias("i"), "type", "name")
    rows = F.split("content", "\n", -1)
    imports = files.select("file_path", F.posexplode(rows).alias("i", "s")).where(F.col("s").rlike(r"^\s*(import|from|use|using|#include|require)(?![A-Za-z0-9_])"))
    both = found.union(imports.select("file_path", "i", F.lit("import"), F.lit(None).cast("string")))
    # Depth before a line: the sum of what opens less what closes, less its least value so far if that is negative.
    net = F.length(F.replace("s", F.lit("}"), F.lit(""))) - F.length(F.replace("s", F.lit("{"), F.lit("")))
    upto = W.partitionBy("file_path").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    deep = files.select("file_path", F.posexplode(rows).alias("i", "s")).select("file_path", "i", net.alias("net"))
    deep = deep.withColumn("sum", F.coalesce(F.sum("net").over(upto), F.lit(0))).withColumn("least", F.coalesce(F.min("sum").over(upto.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    depth = (F.col("sum") - F.least(F.lit(0), F.col("least"))).cast("int")
    return both.join(deep, ["file_path", "i"]).select("file_path", (F.col("i") + 1).alias("line"), "type", "name", depth.alias("depth"))


def boundary_chunks(files: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(file_path, chunk, type, name, start_line, end_line, tokens, hash, content): regions between declarations; a
    region of more than ``most`` tokens is cut by lines as in ``sliding_chunks``; blank regions are dropped.
    """
    marks = boundaries(files).where("type <> 'import'").groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("line", "type", "name"))).alias("marks"))
    rows = files.join(marks, "file_path", "left").select("file_path", F.split("content", "\n", -1).alias("ls"), F.coalesce("marks", F.array().cast("array<struct<line:int,type:string,name:string>>")).alias("marks"))
    head = F.struct(F.lit(1).alias("line"), F.lit("unknown").alias("type"), F.lit(None).cast("string").alias("name"))
    marks = F.when(F.get("marks", 0)["line"] == 1, F.col("marks")).otherwise(F.concat(F.array(head), F.col("marks")))
    # Each mark with the line before the next one; regions are cut inside the array.
    ended = F.transform(F.col("marks"), lambda m, k: F.struct(k.alias("k"), m["type"].alias("type"), m["name"].alias("name"), m["line"].alias("first"), F.coalesce(F.get("marks", k + 1)["line"] - 1, F.size("ls")).alias("end")))
    parts = rows.withColumn("marks", marks).select("file_path", "ls", ended.alias("cuts"))
    body = lambda ls, c: F.array_join(F.slice(ls, c["first"], c["end"] - c["first"] + 1), "\n")
    pieces = pieces_of("cuts", lambda ls, c: F.struct(c["k"].alias("k"), c["type"].alias("type"), c["name"].alias("name"), c["first"].alias("first"), body(ls, c).alias("content")))
    regions = parts.select(F.col("file_path").alias("path"), F.explode(pieces).alias("r")).select("path", "r.*").where(F.col("content").rlike(r"\S"))
    keyed = regions.withColumn("file_path", F.concat_ws("\u0000", "path", F.col("k").cast("string")))
    pieces = sliding_chunks(keyed, most, 1, overlap).withColumnRenamed("content", "piece")
    out = pieces.join(keyed.drop("content"), "file_path")
    order = F.row_number().over(W.partitionBy("path").orderBy("k", "chunk")) - 1
    shift = lambda c: (F.col(c) + F.col("first") - 1).alias(c)
    return out.select(F.col("path").alias("file_path"), order.alias("chunk"), "type", "name", shift("start_line"), shift("end_line"), "tokens", fnv1a64(F.col("piece")).alias("hash"), F.col("piece").alias("content"))


#: Chunk type by declaration type.
CHUNK_TYPES = {"function_declaration": "function", "class_declaration": "class", "interface_declaration": "interface", "struct_declaration": "struct", "trait_declaration": "trait", "type_alias_declaration": "type", "module_declaration": "module", "impl_declaration": "impl", "variable_declaration": "block", "import": "import"}
