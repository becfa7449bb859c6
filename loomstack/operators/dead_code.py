"""Dead code: unused exports and variables, unreachable code, empty blocks, commented-out code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.functions.fixed import COMMENTED_CODE, DECLARATIONS, EMPTY_BLOCKS, VUE_BUILTINS
from loomstack.functions.text import lines, rounded, trim


def unused_exports(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported symbols that no edge reaches by id, name or path:name, outside entry points."""
    used = edges.select(F.col("dst").cast("string").alias("used")).distinct()
    out = symbols.where(F.col("exports") & ~F.col("file_path").rlike(r"(index|main|app)\.(ts|js|tsx|jsx)\z"))
    for key in (F.col("id").cast("string"), F.col("name"), F.concat_ws(":", "file_path", "name")):
        out = out.withColumn("__k", key).join(used, F.col("__k") == F.col("used"), "left_anti").drop("__k")
    return out.select("id", "name", "kind", "file_path", "start_line")


def unused_variables(files: DataFrame, limit: int | None = 100) -> DataFrame:
    """(file_path, name, line) of names declared and used at most once more.

    A use is an occurrence that does not directly follow a declarator; counts
    of all words of a file and of those after declarators are subtracted, so
    no pattern is built from a name.
    """
    rows = files.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    names = F.concat(*[F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(1)), lambda x, k=k: F.struct(x.alias("name"), F.lit(k).alias("k"))) for k, p in enumerate(DECLARATIONS)])
    declared = rows.select("file_path", "i", F.explode(names).alias("d")).select("file_path", (F.col("i") + 1).alias("line"), "d.*")
    declared = declared.where(F.col("name").rlike(r"^[A-Za-z0-9_]+\z") & ~F.col("name").startswith("_") & ~F.col("name").isin(VUE_BUILTINS))
    declared = declared.groupBy("file_path", "name").agg(F.max_by("line", F.struct("k", "line")).alias("line"))
    words = files.select("file_path", F.explode(F.regexp_extract_all("content", F.lit(r"(?:(?:const|let|var|function)\s+)?(?<![A-Za-z0-9_])[A-Za-z0-9_]+"), F.lit(0))).alias("w"))
    after = F.regexp_extract("w", r"^(?:const|let|var|function)\s+([A-Za-z0-9_]+)\z", 1)
    uses = words.where(after == "").groupBy("file_path", F.col("w").alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    out = declared.join(uses, ["file_path", "name"], "left").where(F.coalesce("uses", F.lit(0)) <= 1)
    vue = files.where(F.col("file_path").endswith(".vue")).select("file_path", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_extract("content", r"(?s)<template[^>]*>(.*?)</template>", 1), F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    out = out.join(vue, ["file_path", "name"], "left_anti").select("file_path", "name", "line")
    return out if limit is None else out.orderBy("file_path", "line", "name").limit(limit)


def _unreachable(content: Column) -> Column:
    """Array of (start, end, reason): a fold over the lines of one text."""
    kind = "array<struct<start:int,end:int,reason:string>>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(False).alias("on"), F.lit(0).alias("start"), F.array().cast(kind).alias("out"))
    span = lambda a, b, r: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(r).alias("reason")))
    none = F.array().cast(kind)

    def step(a: Column, s: Column) -> Column:
        i = a["i"]
        skip = a["on"] & (s == "")
        leave = a["on"] & ~skip & (s.rlike(r"^(?:case\s|default\s*:)") | s.rlike(r"^\}\s*else(?![A-Za-z0-9_])"))
        enter = s.rlike(r"^(return|throw|break|continue)(?![A-Za-z0-9_])") & ~s.endswith("{")
        on, start = a["on"] | enter, F.when(enter, i + 2).otherwise(a["start"])
        close = on & s.isin("}", "};", "},")
        found = F.concat(
            a["out"],
            F.when(close & (start < i), span(start, i, "after-jump")).otherwise(none),
            F.when(s.rlike(r"if\s*\(\s*false\s*\)"), span(i + 1, i + 1, "never-true")).otherwise(none),
            F.when(s.rlike(r"while\s*\(\s*false\s*\)"), span(i + 1, i + 1, "never-loops")).otherwise(none),
        )
        pack = lambda on, start, out: F.struct((i + 1).alias("i"), on.alias("on"), start.alias("start"), out.alias("out"))
        return F.when(skip, pack(a["on"], a["start"], a["out"])).when(leave, pack(F.lit(False), a["start"], a["out"])).otherwise(pack(on & ~close, start, found))

    return F.aggregate(F.transform(F.split(content, "\n", -1), trim), zero, step, lambda a: a["out"])


def unreachable_code(files: DataFrame) -> DataFrame:
    """(file_path, start_line, end_line, reason); of Vue files the script section only."""
    vue = F.col("file_path").endswith(".vue")
    head = F.regexp_extract("content", r"(?s)^(.*?)<script[^>]*>.*?</script>", 1)
    script = F.regexp_extract("content", r"(?s)<script[^>]*>(.*?)</script>", 1)
    shift = F.when(vue, F.size(F.split(head, "\n", -1))).otherwise(0)
    rows = files.select("file_path", shift.alias("shift"), F.explode(_unreachable(F.when(vue, script).otherwise(F.col("content")))).alias("u"))
    return rows.select("file_path", (F.col("u.start") + F.col("shift")).alias("start_line"), (F.col("u.end") + F.col("shift")).alias("end_line"), F.col("u.reason").alias("reason"))


def empty_blocks(files: DataFrame) -> DataFrame:
    """(file_path, line, type, name): a line opens a block that the next line closes."""
    rows = F.transform(F.split("content", "\n", -1), trim)
    pairs = files.select("file_path", F.posexplode(F.transform(rows, lambda s, i: F.struct(s.alias("s"), F.get(rows, i + 1).alias("next")))).alias("i", "p")).where("p.next = '}'")
    s = F.col("p.s")
    name = {"function": F.coalesce(F.nullif(F.regexp_extract(s, EMPTY_BLOCKS[0][1], 1), F.lit("")), F.regexp_extract(s, EMPTY_BLOCKS[0][1], 2)), "class": F.regexp_extract(s, r"class\s+(\w+)", 1)}
    kinds = F.array(*[F.when(s.rlike(p), F.struct(F.lit(k).alias("type"), name.get(k, F.lit(None).cast("string")).alias("name"))) for k, p in EMPTY_BLOCKS])
    return pairs.select("file_path", (F.col("i") + 1).alias("line"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("b")).select("file_path", "line", "b.*")


def commented_code(files: DataFrame, least: int = 3) -> DataFrame:
    """(file_path, start_line, end_line, n) of runs of commented-out lines: gaps and islands within a file."""
    rows = lines(files)
    hit = F.lit(False)
    for p in COMMENTED_CODE:
        hit = hit | F.col("line").rlike(p)
    found = rows.where(hit).withColumn("island", F.col("line_no") - F.row_number().over(W.partitionBy("file_path").orderBy("line_no")))
    return found.groupBy("file_path", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("island")


def dead_code_summary(exports: DataFrame, variables: DataFrame, unreachable: DataFrame, empty: DataFrame, commented: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    u = unreachable.agg(F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("unreachable_lines"), F.count(F.lit(1)).alias("unreachable"))
    c = commented.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("commented_lines"), F.count(F.lit(1)).alias("commented"))
    out = n(exports, "unused_exports").crossJoin(n(variables, "unused_variables")).crossJoin(u).crossJoin(n(empty, "empty_blocks")).crossJoin(c)
    hours = F.col("unused_exports") * 0.05 + F.col("unused_variables") * 0.02 + F.col("unreachable") * 0.1 + F.col("empty_blocks") * 0.02 + F.col("commented") * 0.03
    return out.withColumn("hours", rounded(hours, 1))
