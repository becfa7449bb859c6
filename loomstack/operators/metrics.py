"""Code metrics of files, row by row: folds over lines and characters are higher-order functions, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.functions.fixed import COGNITIVE_MOST, COMPLEXITY_MOST, COUPLING_MOST, HALSTEAD_KEYWORDS, HALSTEAD_OPERATORS, LOC_MOST, NESTING_MOST
from loomstack.functions.storage import Table
from loomstack.functions.text import bounded, rounded, trim


def _trimmed_lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n", -1), trim)


def line_counts(content: Column) -> Column:
    """struct(total, code, comments, blank, ratio)."""
    zero = F.struct(F.lit(0).alias("code"), F.lit(0).alias("comments"), F.lit(0).alias("blank"), F.lit(False).alias("block"))

    def step(a: Column, s: Column) -> Column:
        blank, opens = s == "", s.startswith("/*")
        comment = ~blank & (opens | a["block"] | s.startswith("//") | s.startswith("#"))
        block = F.when(blank, a["block"]).when(opens, ~s.endswith("*/")).otherwise(a["block"] & ~s.contains("*/"))
        one = lambda c: c.cast("int")
        return F.struct((a["code"] + one(~blank & ~comment)).alias("code"), (a["comments"] + one(comment)).alias("comments"), (a["blank"] + one(blank)).alias("blank"), block.alias("block"))

    total = F.size(F.split(content, "\n", -1))
    done = lambda a: F.struct(total.alias("total"), a["code"].alias("code"), a["comments"].alias("comments"), a["blank"].alias("blank"), F.when(a["code"] > 0, a["comments"] / a["code"]).otherwise(0.0).alias("ratio"))
    return F.aggregate(_trimmed_lines(content), zero, step, done)


CYCLOMATIC = [bounded("if"), bounded(r"else\s+if"), bounded("for"), bounded("while"), bounded("case"), bounded("catch"), r"(?<=[A-Za-z0-9_])\?\s*[^:]+\s*:", "&&", r"\|\|", r"\?\?"]


def cyclomatic(content: Column) -> Column:
    out = F.lit(1)
    for p, needle in zip(CYCLOMATIC, ["if", "else", "for", "while", "case", "catch", "?", "&&", "||", "??"], strict=True):
        out = out + F.when(F.contains(content, F.lit(needle)), F.regexp_count(content, F.lit(p))).otherwise(0)
    return out


def cognitive(content: Column) -> Column:
    """Nesting-weighted branches; the first kind that a line matches counts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("level"))
    has = lambda s, p: s.rlike(p)

    def step(a: Column, s: Column) -> Column:
        opens = has(s, bounded("(if|for|while|switch|try)") + r".*\{")
        score = (
            F.when(opens, 1 + a["level"])
            .when(has(s, bounded(r"else\s+if")), 1)
            .when(has(s, bounded("else") + r".*\{"), 1)
            .when(has(s, bounded("catch")), 1 + a["level"])
            .when(has(s, r"&&|\|\|"), F.regexp_count(s, F.lit(r"&&|\|\|")))
            .when(has(s, r"(?<![A-Za-z0-9_])(break|continue)\s+\w+"), 1)
            .when(has(s, r"(?<![A-Za-z0-9_])function\s+(\w+).*\1\s*\("), 1)
            .otherwise(0)
        )
        level = a["level"] + opens.cast("int")
        return F.struct((a["n"] + score).alias("n"), F.when(s.contains("}") & (level > 0), level - 1).otherwise(level).alias("level"))

    return F.aggregate(_trimmed_lines(content), zero, step, lambda a: a["n"])


def max_nesting(content: Column) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(a: Column, b: Column) -> Column:
        at = F.when(b == "{", a["at"] + 1).otherwise(F.greatest(F.lit(0), a["at"] - 1))
        return F.struct(at.alias("at"), F.greatest(a["most"], at).alias("most"))

    return F.aggregate(F.regexp_extract_all(content, F.lit("[{}]"), F.lit(0)), zero, step, lambda a: a["most"])


def with_halstead(df: DataFrame, content: str = "content") -> DataFrame:
    """vocabulary, length, volume, difficulty, effort, time, bugs of each row."""
    c = F.col(content)
    # Operators are counted in what is left of a text without all other signs.
    o = F.col("__ops")
    counts = F.array(*[((F.length(o) - F.length(F.replace(o, F.lit(op), F.lit("")))) / len(op)).cast("int") for op in HALSTEAD_OPERATORS])
    # Runs of word characters that do not begin with a digit.
    words = F.filter(F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0)), lambda w: ~w.isin(HALSTEAD_KEYWORDS) & (F.substring(w, 1, 1) >= "A"))
    out = df.withColumn("__ops", F.regexp_replace(c, r"[^-+*/%=<>!&|^~?:.]+", " ")).withColumn("__o", counts).withColumn("__w", words)
    n1, total1 = F.size(F.filter("__o", lambda x: x > 0)), F.aggregate("__o", F.lit(0), lambda a, x: a + x)
    n2, total2 = F.size(F.array_distinct("__w")), F.size("__w")
    out = out.withColumn("vocabulary", n1 + n2).withColumn("length", total1 + total2).withColumn("__d", F.when(n2 > 0, (n1 / 2) * (total2 / n2)).otherwise(0.0))
    out = out.withColumn("__v", F.col("length") * F.log2(F.greatest("vocabulary", F.lit(1))))
    v, d = F.col("__v"), F.col("__d")
    return out.withColumns({"volume": rounded(v, 2), "difficulty": rounded(d, 2), "effort": rounded(d * v, 2), "time": rounded(d * v / 18, 2), "bugs": rounded(v / 3000, 3)}).drop("__ops", "__o", "__w", "__v", "__d")


def maintainability(volume: Column, cc: Column, code: Column, ratio: Column) -> Column:
    v = F.when(volume > 0, volume).otherwise(1.0)
    raw = 171 - 5.2 * F.ln(v) - 0.23 * cc - 16.2 * F.ln(F.greatest(code, F.lit(1))) + 50 * F.sin(F.sqrt(2.4 * ratio))
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171))).cast("int")


def coupling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, afferent, efferent, instability, distance) of file nodes."""
    out, into = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("efferent")), edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("afferent"))
    n = nodes.where("type = 'file'").select("id", "file_path").join(out, "id", "left").join(into, "id", "left").fillna(0, ["efferent", "afferent"])
    total = F.col("afferent") + F.col("efferent")
    i = F.when(total > 0, F.col("efferent") / total).otherwise(0.5)
    return n.select("file_path", "afferent", "efferent", rounded(i, 2).alias("instability"), rounded(F.abs(i - 1), 2).alias("distance"))


def file_metrics(files: DataFrame, couplings: DataFrame | None = None) -> DataFrame:
    """One row for each file; ``couplings`` as given by ``coupling``."""
    c = F.coalesce(F.col("content"), F.lit(""))
    base = files.select("file_path", c.alias("content")).withColumn("loc", line_counts(F.col("content")))
    out = base.withColumns({"cyclomatic": cyclomatic(F.col("content")), "cognitive": cognitive(F.col("content")), "max_nesting": max_nesting(F.col("content"))})
    out = with_halstead(out).drop("content").withColumns({k: F.col(f"loc.{k}") for k in ("total", "code", "comments", "blank", "ratio")}).drop("loc")
    out = out.withColumn("maintainability", maintainability(F.col("volume"), F.col("cyclomatic"), F.col("code"), F.col("ratio")))
    if couplings is None:
        return out.withColumns({"afferent": F.lit(0).cast("long"), "efferent": F.lit(0).cast("long"), "instability": F.lit(0.5), "distance": F.lit(0.5)})
    return out.join(couplings, "file_path", "left").fillna(0, ["afferent", "efferent"]).fillna(0.5, ["instability", "distance"])


def function_complexity(metrics: DataFrame, symbols: DataFrame) -> DataFrame:
    """``metrics`` with avg_function_complexity: the file's complexity over its functions, or whole if it has none."""
    functions = symbols.where("kind = 'function'").groupBy("file_path").agg(F.count(F.lit(1)).alias("__n"))
    return metrics.join(functions, "file_path", "left").withColumn("avg_function_complexity", F.col("cyclomatic") / F.coalesce("__n", F.lit(1))).drop("__n")


def issues(metrics: DataFrame) -> DataFrame:
    """(file_path, type, severity, value) beyond the thresholds."""
    one = lambda kind, name, high, medium: F.when(high, F.struct(F.lit(kind).alias("type"), F.lit("high").alias("severity"), F.col(name).cast("long").alias("value"))).when(medium, F.struct(F.lit(kind).alias("type"), F.lit("medium").alias("severity"), F.col(name).cast("long").alias("value")))
    over = lambda kind, name, most: one(kind, name, F.col(name) > 2 * most, F.col(name) > most)
    m = F.col("maintainability")
    found = F.array(
        over("complexity", "cyclomatic", COMPLEXITY_MOST), over("cognitive", "cognitive", COGNITIVE_MOST), one("nesting", "max_nesting", F.col("max_nesting") > 6, F.col("max_nesting") > NESTING_MOST),
        over("size", "code", LOC_MOST), over("coupling", "efferent", COUPLING_MOST), one("maintainability", "maintainability", m < 20, m < 40),
    )
    return metrics.select("file_path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("file_path", "i.*")


def project_summary(metrics: DataFrame, found: DataFrame) -> DataFrame:
    """One row of totals, means, debt in hours and a grade."""
    a = metrics.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("code"), F.lit(0)).alias("total_loc"), F.coalesce(F.avg("cyclomatic"), F.lit(0.0)).alias("cc"), F.coalesce(F.avg("maintainability"), F.lit(100.0)).alias("mi"), F.coalesce(F.avg("efferent"), F.lit(0.0)).alias("ce"))
    b = found.agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    mi, cc = F.col("mi"), F.col("cc")
    grade = F.when((mi >= 80) & (cc <= 5), "A").when((mi >= 60) & (cc <= 10), "B").when((mi >= 40) & (cc <= 15), "C").when(mi >= 20, "D").otherwise("F")
    return a.crossJoin(b).select("total_files", "total_loc", rounded(cc, 1).alias("avg_complexity"), rounded(mi).alias("avg_maintainability"), rounded(F.col("ce"), 1).alias("avg_coupling"), rounded(F.col("high") * 0.5 + F.col("medium") * 0.25, 1).alias("debt_hours"), grade.alias("grade"))


def hotspots(metrics: DataFrame, limit: int = 20) -> DataFrame:
    """(file_path, score, reasons) of the worst files."""
    part = lambda over, score, name: F.when(over, F.struct(score.cast("double").alias("s"), F.lit(name).alias("r")))
    cc, code, ce, mi = (F.col(x) for x in ("cyclomatic", "code", "efferent", "maintainability"))
    parts = F.filter(
        F.array(
            part(cc > COMPLEXITY_MOST, F.least(F.lit(30.0), F.log2(cc / COMPLEXITY_MOST) * 15), "complexity"),
            part(code > LOC_MOST, F.least(F.lit(25.0), F.log2(code / LOC_MOST) * 10), "size"),
            part(ce > COUPLING_MOST, F.least(F.lit(20.0), (ce - COUPLING_MOST) * 2.0), "coupling"),
            part(mi < 40, F.least(F.lit(25.0), (40 - mi) * 0.625), "maintainability"),
        ),
        lambda x: x.isNotNull(),
    )
    # A narrow table: a filter on metrics would otherwise be pushed down and compute them again.
    out = Table(metrics.select("file_path", "cyclomatic", "code", "efferent", "maintainability"), "metrics").df.withColumn("p", parts).where(F.size("p") > 0)
    score = rounded(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["s"]))
    return out.select("file_path", score.alias("score"), F.array_join(F.transform("p", lambda x: x["r"]), ",").alias("reasons")).orderBy(F.desc("score"), "file_path").limit(limit)
