"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Measures are columns computed row by row, without a shuffle.  A rule is a SQL
predicate that is true for a text to reject.  ``order_rules`` times every rule
and counts what it rejects on a bounded random sample of rows; ``quality_cascade``
evaluates the rules in the order of rejection per cost as one CASE, in which
a rule runs only on rows that all earlier ones let pass.  The verdict does not
depend on the order, only the time does.

Edge cases: a null or empty text has no words and zero measures; a rule whose
predicate is null lets the row pass; an empty sample leaves the given order;
columns named like results are replaced; repeated rows are judged each; texts
are measured whole, however long.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm.common import WORD_RE, replace_columns

#: Rows of the sample on which cost and selectivity are estimated, and the longest text in it.
SAMPLE_ROWS, SAMPLE_CHARS, SEED = 256, 1 << 17, 29
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``reject``: SQL over the row's columns, the measures among them."""

    name: str
    reject: str


def has_word_lines(text: str) -> str:
    return rf"filter(split({text}, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"


#: Published heuristics for web text: share of symbols, mean word length, repeated lines, capitals.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("dup_lines", f"n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * size({has_word_lines('text')})"),
    Rule("capitals", r"2 * regexp_count(text, '\\p{Lu}') > word_chars"),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(windows: Column) -> Column:
    """Words covered by windows (hashes, in order) that occur at least twice."""

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        again = F.filter(pairs, lambda e, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == e["h"])) | ((k + 1 < n) & (F.get(pairs, k + 1)["h"] == e["h"])))
        starts = F.sort_array(F.transform(again, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(a["end"], s)).alias("n"), (s + WINDOW).alias("end"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    distinct = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(distinct, 0).otherwise(_let(pairs, covered)).cast("long")


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of ``MEASURES``, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.expr(has_word_lines(f"coalesce(`{text}`, '')"))
    words, windows = F.col("__words"), F.col("__windows")
    out = replace_columns(df, MEASURES).withColumn("__words", F.regexp_extract_all(t, F.lit(WORD_RE), F.lit(0))).withColumn("__lines", lines)
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("__windows", F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": repeated_words(windows),
    }
    return out.withColumns({k: v.cast("long") for k, v in measures.items()}).drop("__words", "__lines", "__windows")


def order_rules(df: DataFrame, rules: tuple[Rule, ...], text: str = "text", rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejection per cost on about ``rows`` rows, drawn by a hash of the text from all of the table (cost: seconds over those of a bare scan)."""
    spark = df.sparkSession
    every = df.select(text).count()
    # By a hash of the text, which Catalyst tests before any measure is taken; ``sample`` would measure all rows first.
    drawn = df if every <= rows else df.where(F.pmod(F.xxhash64(F.lit(SEED), text), F.lit(every)) < rows)
    some = drawn.where(F.length(text) <= SAMPLE_CHARS).select(*[c for c in df.columns if c == text or c in MEASURES]).limit(2 * rows).collect()
    if not some:
        return rules
    sample = spark.createDataFrame(some, df.select(*some[0].asDict()).schema).coalesce(1).cache()
    n = sample.count()

    def seconds(columns: list[Column]) -> tuple[float, int]:
        begun = time.perf_counter()
        rejected = sample.select(F.count_if(F.coalesce(columns[0], F.lit(False)))).first()[0]
        return time.perf_counter() - begun, rejected

    seconds([F.lit(False)])
    idle = min(seconds([F.lit(False)])[0] for _ in range(2))
    value = {}
    for r in rules:
        cost, rejected = min(seconds([F.expr(r.reject)]) for _ in range(2))
        value[r.name] = (rejected / n) / max(cost - idle, 1e-4)
    sample.unpersist()
    return tuple(sorted(rules, key=lambda r: -value[r.name]))


def quality_cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, skip: Column | None = None, text: str = "text", verdict: str = "kept") -> DataFrame:
    """``df`` (with measures) and a boolean: no rule rejects the row.  Rows where ``skip`` holds are rejected first."""
    kept = F.when(skip, False) if skip is not None else F.when(F.lit(False), False)
    for r in order_rules(df, rules, text):
        kept = kept.when(F.expr(r.reject), False)
    return replace_columns(df, [verdict]).withColumn(verdict, kept.otherwise(True))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = with_measures(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = quality_cascade(docs.withColumn("base_failed", failed), skip=F.col("base_failed"))
    return out.select("doc_id", *MEASURES, "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS r(i)),
s AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), unnest(range(8)) AS x(o)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT doc_id, t, len(ls) AS n_lines, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
       OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 2 * len(regexp_extract_all(t, '\p{Lu}')) > word_chars) AS kept
FROM b
"""
