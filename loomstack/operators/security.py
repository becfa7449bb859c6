"""Vulnerability and secret scans, and the pattern engine that bug and performance hints share.

All patterns are tried in one pass over the contents: each gives an array of
matches (empty unless the pattern is there), the arrays are put together and
exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.functions import fixed
from loomstack.functions.text import matches, rounded


def _flag(pattern: str, ignore_case: bool) -> str:
    return f"(?i){pattern}" if ignore_case else pattern


def path_is(pattern: str, path: str = "file_path") -> Column:
    return F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/"))).rlike(pattern)


def _around(content: Column, m: Column) -> Column:
    """200 characters on either side of where the match starts."""
    start = F.greatest(m["offset"] - 200, F.lit(0))
    return F.substring(content, start + 1, m["offset"] + 200 - start)


CONTEXT = {
    "not-frontend": lambda code: ~path_is(fixed.FRONTEND_PATH),
    "vue": lambda code: F.col("file_path").endswith(".vue"),
    "server": lambda code: path_is(fixed.SERVER_PATH),
    "shell": lambda code: ~path_is(fixed.FRONTEND_PATH) & code.rlike("exec|spawn|child_process"),
    "secret-word": lambda code: code.rlike(fixed.SECRET_WORD),
    "log-auth": lambda code: code.rlike(fixed.LOG_AUTH),
    "log-token": lambda code: ~(code.rlike(fixed.LOG_BENIGN) | (code.rlike(fixed.LOG_KEY) & ~code.rlike(fixed.LOG_REAL_KEY)) | code.rlike(fixed.LOG_TOKENS)),
}


#: What a text must contain, in lower case, for a pattern to have a chance; found far faster than the pattern.
VULNERABILITY_NEEDLES = [
    "query execute raw", ".query", "innerhtml", "document.write", "dangerouslysetinnerhtml", "v-html", "exec spawn", "child_process",
    "readfile writefile createreadstream access stat unlink", "readfile writefile createreadstream open access", "math.random", "createhash", "createcipher",
    "redirect location.href window.location", "fetch axios request http.get", "[req. [params. [query. [body.", "object.assign", "regexp", "console.log", "console.log",
    "console.log", "cors", "eval", "function",
]
SECRET_NEEDLES = ["api", "key", "akia", "aws", "passw pwd", "password", "private", "openssh", "secret", "eyj", "://", "secret", "secret", "token"]


def scan(files: DataFrame, patterns: list[str], keep=None, needles: list[str] | None = None) -> DataFrame:
    """(file_path, k, line, offset, text, before, row) of every match of patterns; ``row`` is its line of text.

    ``keep[k]`` takes the surrounding code of a match and says whether it
    counts; a pattern is only tried on texts with one of its ``needles``.
    """
    content, low = F.col("content"), F.col("__low")

    def chance(k: int) -> Column:
        out = F.lit(False)
        for n in needles[k].split() if needles else ():
            out = out | F.contains(low, F.lit(n))
        return out if needles else F.lit(True)

    def of(k: int, p: str) -> Column:
        found = matches(content, p)
        if keep and keep[k]:
            found = F.filter(found, lambda m: keep[k](_around(content, m)))
        hits = F.transform(found, lambda m: F.struct(F.lit(k).alias("k"), m["line"].alias("line"), m["offset"].alias("offset"), m["text"].alias("text")))
        return F.when(chance(k), hits).otherwise(F.array().cast("array<struct<k:int,line:int,offset:int,text:string>>"))

    def placed(both: Column) -> Column:
        """Matches with what stands before them in their line, and the line: cut here, so that no text goes along with a match."""
        before = lambda m: F.substring_index(F.substring(both["content"], F.lit(1), m["offset"]), "\n", -1)
        return F.transform(both["hits"], lambda m: F.struct(m["k"].alias("k"), m["line"].alias("line"), m["offset"].alias("offset"), m["text"].alias("text"), before(m).alias("before"), F.get(both["rows"], m["line"] - 1).alias("row")))

    every = F.concat(*[of(k, p) for k, p in enumerate(patterns)])
    low_files = files.withColumn("__low", F.lower("content"))
    hit = low_files.select("file_path", "content", every.alias("hits")).where(F.size("hits") > 0)
    whole = F.struct("content", "hits", F.split(content, "\n", -1).alias("rows"))
    found = F.flatten(F.transform(F.array(whole), placed))
    return hit.select("file_path", F.explode(found).alias("m")).select("file_path", "m.*")


def _first(df: DataFrame, *order) -> DataFrame:
    """One finding for each file, line and type."""
    rank = F.row_number().over(W.partitionBy("file_path", "line", "type").orderBy(*order))
    return df.withColumn("r", rank).where("r = 1").drop("r")


def vulnerabilities(files: DataFrame) -> DataFrame:
    """(file_path, line, type, severity, title, cwe, code) outside vendor files and comments."""
    table = fixed.VULNERABILITIES
    scanned = files.where(path_is(fixed.SCANNED_PATH) & ~path_is(fixed.VENDOR_PATH))
    found = scan(scanned, [_flag(p, i) for *_, p, i, _ in table], [CONTEXT.get(c) for *_, c in table], VULNERABILITY_NEEDLES)
    found = found.where(~F.ltrim(F.regexp_replace("before", "^[ \t]+", "")).rlike(r"^(//|/\*|\*)"))
    pick = lambda i: F.element_at(F.array(*[F.lit(v[i]) for v in table]), F.col("k") + 1)
    out = found.select("file_path", "line", pick(0).alias("type"), pick(1).alias("severity"), pick(2).alias("title"), pick(3).alias("cwe"), F.substring(F.col("row"), 1, 100).alias("code"), "k", "offset")
    severity = F.when((F.col("type") == "xss") & F.col("file_path").endswith(".vue") & path_is(fixed.FRONTEND_PATH), "medium").when((F.col("type") == "insecure-deserialization") & path_is(fixed.CONFIG_PATH), "info").otherwise(F.col("severity"))
    return _first(out.withColumn("severity", severity), "k", "offset").drop("k", "offset")


def secrets(files: DataFrame) -> DataFrame:
    """(file_path, line, type, confidence, preview) with the value masked."""
    table = fixed.SECRETS
    scanned = files.where(path_is(fixed.SCANNED_PATH) & ~path_is(fixed.VENDOR_PATH))
    found = scan(scanned, [_flag(p, i) for *_, p, i in table], None, SECRET_NEEDLES)
    line = F.regexp_replace("row", r"^\s+", "")
    found = found.where(~line.rlike(r"^(//|#)") & ~F.col("row").rlike(r"example|placeholder|process\.env|getenv"))
    n = F.length("text")
    mask = F.when(n <= 10, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring("text", 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(F.col("text"), n - 3, F.lit(4))))
    pick = lambda i: F.element_at(F.array(*[F.lit(v[i]) for v in table]), F.col("k") + 1)
    out = found.select("file_path", "line", pick(0).alias("type"), pick(1).alias("confidence"), mask.alias("preview"), "k", "offset")
    return _first(out, "k", "offset").drop("k", "offset")


def security_summary(vulns: DataFrame, found: DataFrame) -> DataFrame:
    """Counts, a risk of 0 to 100 and a grade."""
    v = vulns.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])
    s = found.agg(F.count_if(F.col("confidence") == "high").alias("s_high"), F.count_if(F.col("confidence") == "medium").alias("s_medium"))
    cap = lambda c, each, most: F.least(F.col(c) * F.lit(float(each)), F.lit(float(most)))
    risk = F.least(F.lit(100.0), cap("critical", 25, 50) + cap("high", 10, 30) + cap("medium", 1, 15) + cap("low", 0.5, 5) + cap("s_high", 20, 30) + cap("s_medium", 5, 10))
    out = v.crossJoin(s).withColumn("risk", rounded(risk))
    r = F.col("risk")
    grade = (
        F.when(F.col("critical") > 0, F.when(r > 50, "F").otherwise("D"))
        .when(F.col("high") > 0, F.when(r > 40, "D").otherwise("C"))
        .when(r == 0, "A")
        .when(r <= 5, "B")
        .otherwise("C")
    )
    return out.withColumn("grade", grade)


def by_type(vulns: DataFrame) -> DataFrame:
    return vulns.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def ci_gate(findings: DataFrame, fail_on: str = "high", severity: str = "severity") -> DataFrame:
    """(n, worst, failed): whether any finding reaches the severity; "none" never fails."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in fixed.SEVERITY_RANK.items() for x in kv])[F.col(severity)], F.lit(0))
    limit = fixed.SEVERITY_RANK[fail_on]
    return findings.agg(F.count(F.lit(1)).alias("n"), F.max_by(severity, rank).alias("worst"), F.coalesce((F.max(rank) >= limit) & F.lit(limit > 0), F.lit(False)).alias("failed"))


def bug_patterns(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(file_path, line, name, severity) of lines that look wrong, worst first."""
    table = fixed.BUG_PATTERNS
    rows = files.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("i", "row"))
    hits = F.filter(F.array(*[F.when(F.col("row").rlike(_flag(p, i)), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for n, s, p, i in table]), lambda x: x.isNotNull())
    out = rows.select("file_path", (F.col("i") + 1).alias("line"), F.explode(hits).alias("h")).select("file_path", "line", "h.*")
    return out if limit is None else worst(out, limit)


def worst(found: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most severe findings."""
    rank = F.create_map(*[F.lit(x) for kv in fixed.SEVERITY_RANK.items() for x in kv])[F.col("severity")]
    return found.orderBy(F.desc(rank), "file_path", "line", "name").limit(limit)


def bugs_near(files: DataFrame, symbols: DataFrame, ahead: int = 50) -> DataFrame:
    """Findings of ``bug_patterns`` within ``ahead`` lines from where a symbol (file_path, start_line) begins."""
    spots = symbols.select("file_path", F.col("start_line").alias("at")).distinct()
    found = bug_patterns(files.join(spots.select("file_path").distinct(), "file_path", "left_semi"))
    return found.join(spots, (found.file_path == spots.file_path) & found.line.between(spots["at"], spots["at"] + ahead), "left_semi")


def performance_hints(files: DataFrame, limit: int | None = 10) -> DataFrame:
    """(file_path, line, name, severity) of slow patterns, critical first."""
    table = fixed.PERFORMANCE_PATTERNS
    found = scan(files, [_flag(p, i) for _, _, p, i in table])
    pick = lambda i: F.element_at(F.array(*[F.lit(v[i]) for v in table]), F.col("k") + 1)
    out = found.select("file_path", "line", pick(0).alias("name"), pick(1).alias("severity"))
    if limit is None:
        return out
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return out.orderBy(rank, "file_path", "line", "name").limit(limit)
