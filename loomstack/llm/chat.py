"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what
follows in either conversation is a completion, with spans (start, end), in
characters of the completion, of the assistant texts on which a loss counts.

Edge cases: null roles and texts render as empty and equal each other only;
equal conversations have empty completions; a side without turns has an empty
completion and the prompt is empty; a pair that lacks a side is returned with
that side empty; repeated turn numbers are ordered by role and text; an empty
table gives no pair; texts are rendered whole, however long; columns of the
pairs named like a result are replaced, all others are kept.  A conversation is
gathered in one row, so its turns together must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm.common import replace_columns

TURNS = "array<struct<role:string,text:string>>"
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def gather_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row (key, turns) for each conversation, in the order of turns."""
    sort = F.sort_array(F.collect_list(F.struct(F.col(order).alias("turn"), "role", "text")))
    return turns.groupBy(key).agg(F.transform(sort, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _render(t: Column) -> Column:
    e = lambda c: F.coalesce(t[c], F.lit(""))
    return F.concat(F.lit(OPEN), e("role"), F.lit(MIDDLE), e("text"), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def loss_spans(turns: Column) -> Column:
    """(start, end) of each assistant text and its closing mark in the rendered turns."""
    head = lambda t: F.length(F.coalesce(t["role"], F.lit(""))) + len(OPEN) + len(MIDDLE)
    sized = F.transform(turns, lambda t: F.struct((t["role"] == "assistant").alias("loss"), head(t).alias("head"), F.length(_render(t)).alias("size")))
    ends = F.aggregate(sized, F.array(F.lit(0)).cast("array<int>"), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["size"])))

    def spans(both: Column) -> Column:
        found = F.transform(both["sized"], lambda t, i: F.when(t["loss"], F.struct((F.get(both["ends"], i) + t["head"]).alias("start"), F.get(both["ends"], i + 1).alias("end"))))
        return F.filter(found, lambda s: s.isNotNull())

    # Both arrays are values of a lambda, so they are computed once and not for every turn.
    return F.transform(F.array(F.struct(sized.alias("sized"), ends.alias("ends"))), spans)[0]


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Columns of ``pairs`` but the two arrays of turns; prompt, completions and their loss spans."""
    empty = F.array().cast(TURNS)
    a, b = F.coalesce(F.col(chosen), empty), F.coalesce(F.col(rejected), empty)
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    at = F.array_position(same, False)
    n = F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")
    results = ["n_prompt_turns", "prompt", *(f"{s}_{c}" for s in ("chosen", "rejected") for c in ("completion", "spans"))]
    out = replace_columns(pairs.withColumn("__a", a).withColumn("__b", b).withColumn("__n", n).drop(chosen, rejected), results).withColumnRenamed("__n", "n_prompt_turns")
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    out = out.withColumn("prompt", render(F.slice("__a", 1, F.col("n_prompt_turns"))))
    for side, c in (("chosen", "__a"), ("rejected", "__b")):
        out = out.withColumn(f"{side}_completion", render(rest(F.col(c)))).withColumn(f"{side}_spans", loss_spans(rest(F.col(c))))
    return out.drop("__a", "__b")


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the last turn of its partner (id with the last bit flipped)."""
    convs = gather_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    last = convs.select((F.col("conv_id").bitwiseXOR(F.lit(1))).alias("conv_id"), F.slice("turns", -1, 1).alias("last"))
    pairs = convs.join(last, "conv_id", "left").select(
        "conv_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", 1, F.size("turns") - 1), F.coalesce("last", F.array().cast(TURNS))).alias("rejected")
    )
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    out = format_preferences(pairs)
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen_completion", "rejected_completion", spans(F.col("chosen_spans")).alias("chosen_spans"), spans(F.col("rejected_spans")).alias("rejected_spans"))


OP8_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, '') AS role, role AS r0, coalesce(text, '') AS text, text AS t0
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (SELECT conv_id, i, n, role, r0, text, t0 FROM t WHERE i < n
      UNION ALL SELECT x.conv_id, x.n, x.n, y.role, y.r0, y.text, y.t0 FROM t x JOIN t y ON y.conv_id = xor(x.conv_id, 1::BIGINT) AND y.i = y.n WHERE x.i = x.n),
d AS (SELECT a.conv_id, min(i) - 1 AS k FROM t a LEFT JOIN b USING (conv_id, i)
      WHERE b.conv_id IS NULL OR a.r0 IS DISTINCT FROM b.r0 OR a.t0 IS DISTINCT FROM b.t0 GROUP BY 1),
p AS (SELECT conv_id, max(t.n) AS n, coalesce(max(k), max(t.n)) AS k FROM t LEFT JOIN d USING (conv_id) GROUP BY 1),
f AS (SELECT 'p' AS side, conv_id, i, role, text FROM t JOIN p USING (conv_id) WHERE i <= k
      UNION ALL SELECT 'c', conv_id, i, role, text FROM t JOIN p USING (conv_id) WHERE i > k
      UNION ALL SELECT 'r', conv_id, i, role, text FROM b JOIN p USING (conv_id) WHERE i > k),
g AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM f),
h AS (SELECT *, sum(length(s)) OVER (PARTITION BY side, conv_id ORDER BY i) AS e FROM g),
j AS (SELECT side, conv_id, string_agg(s, '' ORDER BY i) AS s,
        coalesce(string_agg(CAST(e - length(s) + length(role) + 5 AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS m FROM h GROUP BY 1, 2)
SELECT p.conv_id, CAST(k AS INT) AS n_prompt_turns, coalesce(x.s, '') AS prompt, coalesce(c.s, '') AS chosen_completion, coalesce(r.s, '') AS rejected_completion,
       coalesce(c.m, '') AS chosen_spans, coalesce(r.m, '') AS rejected_spans
FROM p LEFT JOIN j x ON x.side = 'p' AND x.conv_id = p.conv_id LEFT JOIN j c ON c.side = 'c' AND c.conv_id = p.conv_id LEFT JOIN j r ON r.side = 'r' AND r.conv_id = p.conv_id
"""
