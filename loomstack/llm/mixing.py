"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its weight's share of the total, at most
``max_repeat`` times its own size, the excess going to the others by weight
until none is above.  Within a source document i is to be taken m_i times on
average: m_i = min(max_repeat, lambda * measure(size_i)), lambda such that the
words come to the target.  The measure is the square root of the size, so that
of two texts the longer, which shows more context, is the likelier; with
``measure=even`` all documents of a source have one chance.

The certain whole copies, floor(m_i), are given first.  The rest is drawn by
Pareto order sampling with the document's own inclusion probability
f_i = m_i - floor(m_i): it has the rank Q_i = [u_i / (1 - u_i)] / [f_i / (1 - f_i)],
and the smallest ranks are taken until the words left for the source are
filled (a sample of fixed size in words); the last one is taken if that comes
nearer.  u_i is a hash of the seed and the id.

The cut is found without ordering a source in one task: a rank is 40 bits of
Q/(1+Q), and words are summed in at most 2**14 bins, three times.  Rows of
the cut's rank are ordered by id and size; where they are equal in these too,
they are numbered partition by partition, so a group of any size is cut inside.
lambda comes from counts of distinct sizes, at most as many as the longest
text has words.  No text is stored or shuffled, but those of rows equal to a cut.

Edge cases: a null source is a source of its own; a null or empty text has
size 0 and takes 0 words; a source without words has target 0; of rows equal
in rank, id and size as many are taken as the target asks for; null ids share
one rank for each size; an empty table gives an empty result; columns named
like results are replaced; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.llm.common import WORD_RE, Table, replace_columns

#: Bits of a rank, and where the steps of the search for a cut end, from the highest bit on.
RANK_BITS, STEPS = 40, (40, 27, 14, 0)
RESULTS = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def even(size: Column) -> Column:
    return F.lit(1.0)


def source_targets(sources: DataFrame, max_repeat: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with its target; one small aggregate per round of resharing."""
    size, cap = F.col("source_size"), F.col("source_size") * F.lit(float(max_repeat))
    level = float("inf")
    total = sources.agg(F.sum(size)).first()[0] or 0
    capped = F.lit(False)
    while total:
        c, w, n = sources.agg(F.sum(F.when(capped, cap).otherwise(F.lit(0.0))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if not w:
            break
        level = (total - c) / w
        capped = F.col("weight") * F.lit(level) > cap
        if sources.agg(F.count_if(capped)).first()[0] == n:
            break
    return sources.withColumn("target", F.when(capped, cap).otherwise(F.col("weight") * F.lit(level)) if total else F.lit(0.0))


def uniform(doc_id: Column, seed: int) -> Column:
    """52 bits of md5 as a number strictly between 0 and 1."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _levels(sizes: DataFrame, measure, max_repeat: float) -> DataFrame:
    """(__key, lambda) from the counts n of each size of a source: the longest texts are at ``max_repeat``, the rest share the target left."""
    words, w = F.col("size") * F.col("n"), measure(F.col("size"))
    by = W.partitionBy("__key")
    used = F.coalesce(F.sum(max_repeat * words).over(by.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(w * words).over(by.orderBy("size").rowsBetween(W.unboundedPreceding, 0))
    tried = sizes.where("size > 0").withColumn("__lambda", (F.col("target") - used) / rest)
    return tried.where(F.col("__lambda") * w <= max_repeat).groupBy("__key").agg(F.max_by("__lambda", "size").alias("__lambda"))


def _cuts(ranked: DataFrame, params: DataFrame) -> DataFrame:
    """(__key, __cut, __last, __quota, __equal): rank and (id, size) at which a source's words are filled, rows to take of these, rows of these."""
    at = params.where("__need > 0").select("__key", F.col("__need").alias("need"), F.lit(0).cast("long").alias("cut"))
    ranked = ranked.where("__rank is not null")
    for above, shift in zip(STEPS, STEPS[1:]):
        here = ranked.join(at, "__key").where(F.shiftright("__rank", above) == F.col("cut"))
        sums = here.groupBy("__key", "need", F.shiftright("__rank", shift).alias("bin")).agg(F.sum("size").alias("n"))
        done = F.sum("n").over(W.partitionBy("__key").orderBy("bin"))
        reach = sums.withColumn("left", F.col("need") - (done - F.col("n"))).where(F.col("left") <= F.col("n"))
        at = reach.groupBy("__key").agg(F.min("bin").alias("cut"), F.min_by("left", "bin").alias("need"))
    same = ranked.join(at, "__key").where(F.col("__rank") == F.col("cut")).groupBy("__key", "cut", "need", "__id", "size").agg(F.count(F.lit(1)).alias("n"))
    words = F.col("size") * F.col("n")
    left = F.col("need") - (F.sum(words).over(W.partitionBy("__key").orderBy("__id", "size")) - words)
    quota = F.least(F.col("n"), F.ceil(F.try_divide(F.col("left"), F.col("size")) + 0.5) - 1)
    best = F.max(F.struct(F.struct("__id", "size").alias("last"), quota.alias("quota"), "n")).alias("b")
    return same.withColumn("left", left).where("left > 0").groupBy("__key", F.col("cut").alias("__cut")).agg(best).select("__key", "__cut", F.col("b.last").alias("__last"), F.col("b.quota").alias("__quota"), F.col("b.n").alias("__equal"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number from 1 within their source: by partition of a stored table, then by the rows before the partition."""
    stored = Table(rows.withColumn("__row", F.monotonically_increasing_id()), "mix-ties").df
    part = F.shiftright("__row", 33).alias("__part")
    before = F.sum("__n").over(W.partitionBy("__key").orderBy("__part")) - F.col("__n")
    counts = stored.groupBy("__key", part).agg(F.count(F.lit(1)).alias("__n")).select("__key", "__part", before.alias("__before"))
    local = F.row_number().over(W.partitionBy("__key", "__part").orderBy("__row"))
    return stored.withColumn("__part", part).withColumn("__local", local).join(counts, ["__key", "__part"]).withColumn("__number", F.col("__before") + F.col("__local")).drop("__row", "__part", "__local", "__before")


def mix_sources(
    docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", max_repeat: float = 3.0, measure=F.sqrt, seed: int = 17, keep_text: bool = False
) -> DataFrame:
    """Rows of ``docs`` with size, source_size, target, copies and taken (words).

    ``weights`` has one row (source, weight) for each source; a source without
    one weighs 0.  With ``keep_text`` all columns of ``docs`` are returned,
    else only the id and the source.
    """
    kept = replace_columns(docs, RESULTS)
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    rows = kept.withColumn("size", word_count(F.col(text))).withColumn("__key", key).withColumn("__id", F.col(id_col))
    narrow = Table(rows.select(id_col, F.col(source).alias("source"), "size", "__key", "__id"), "mix").df
    if not keep_text:
        rows = narrow
    n = narrow.count()
    sizes = narrow.groupBy("__key", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = Table(sizes, "mix-sizes", n).df
    weigh = weights.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__key"), F.col("weight").cast("double").alias("weight"))
    totals = sizes.groupBy("__key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = source_targets(Table(totals.join(weigh, "__key", "left").fillna(0.0, ["weight"]), "mix-sources", n).df, max_repeat).drop("weight")
    level = _levels(sizes.join(sources, "__key"), measure, max_repeat)
    sources = sources.join(level, "__key", "left").fillna(float("inf"), ["__lambda"])
    mean = F.when(F.col("size") > 0, F.least(F.lit(float(max_repeat)), F.col("__lambda") * measure(F.col("size")))).otherwise(0.0)
    whole = F.floor(mean + 1e-9)
    f = F.greatest(mean - whole, F.lit(0.0))
    given = sizes.join(sources, "__key").groupBy("__key").agg(F.sum(whole * F.col("size") * F.col("n")).alias("__given"))
    params = Table(sources.join(given, "__key").withColumn("__need", F.col("target") - F.col("__given")).drop("__given"), "mix-params", n).df
    u = uniform(F.col("__id"), seed)

    def ranks(df: DataFrame) -> DataFrame:
        df = df.join(params, "__key").withColumn("__whole", whole).withColumn("__f", f).withColumn("__u", u)
        q = F.try_divide(F.col("__u") * (1 - F.col("__f")), (1 - F.col("__u")) * F.col("__f"))
        return df.withColumn("__q", q).withColumn("__rank", F.when(F.col("__f") > 1e-9, F.floor(F.col("__q") / (1 + F.col("__q")) * float(1 << RANK_BITS))))

    known = ["source_size", "target", "__lambda", "__need"]
    scored = Table(ranks(narrow).drop(*known, "__f", "__u", "__q"), "mix-ranks", n).df
    cuts = Table(_cuts(scored.select("__key", "__id", "size", "__rank"), params), "mix-cuts", n).df
    out = (ranks(rows) if keep_text else scored.join(params, "__key")).join(cuts, "__key", "left")
    here, there = F.struct("__rank", "__id", "size"), F.struct("__cut", "__last.__id", "__last.size")
    tied = F.coalesce((F.col("__need") > 0) & (F.col("__rank") == F.col("__cut")) & F.col("__id").eqNullSafe(F.col("__last.__id")) & (F.col("size") == F.col("__last.size")), F.lit(False))
    drawn = F.when(F.col("__rank").isNull() | (F.col("__need") <= 0), False).when(F.col("__cut").isNull(), True).when(tied, F.col("__quota") > 0).otherwise(here < there)
    copies = lambda more: (F.col("__whole") + more.cast("long")).cast("long").alias("copies")
    names = [F.col(f"`{c}`") for c in (kept.columns if keep_text else [id_col, "source"])] + [F.col(c) for c in ("size", "source_size", "target")]
    if not cuts.where("__equal > 1").limit(1).count():
        return out.select(*names, copies(drawn)).withColumn("taken", F.col("copies") * F.col("size"))
    tied = tied & (F.col("__equal") > 1)
    alone = out.where(~tied).select(*names, copies(drawn))
    equal = _numbered(out.where(tied)).select(*names, copies(F.col("__number") <= F.col("__quota")))
    return alone.unionByName(equal).withColumn("taken", F.col("copies") * F.col("size"))


def cyclic_weights(docs: DataFrame, source: str = "source", period: int = 3) -> DataFrame:
    """Sources by code point, null last, weigh 1, 2, ... period, 1, 2, ...; ranges of sources are counted apart."""
    names = docs.select(F.col(source).alias("source")).distinct()
    stored = Table(names.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-names", 0).df
    before = F.sum("n").over(W.orderBy("part")) - F.col("n")
    counts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    at = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return stored.withColumn("at", at).join(counts, "part").select("source", ((F.col("before") + F.col("at") - 1) % period + 1).cast("double").alias("weight"))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes from each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = mix_sources(docs, cyclic_weights(docs))
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
        sum(w) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s),
l AS (SELECT min_by((total::DOUBLE - used::DOUBLE) / ws, 3 * source_size / w) AS lam FROM o
      WHERE (total::DOUBLE - used::DOUBLE) / ws <= 3 * source_size / w),
t AS (SELECT source, source_size, CASE WHEN w * lam > source_size * 3.0::DOUBLE THEN source_size * 3.0::DOUBLE ELSE w * lam END AS target FROM s, l),
h AS (SELECT source, size, count(*) AS n, sqrt(size::DOUBLE) AS w FROM d WHERE size > 0 GROUP BY 1, 2),
v AS (SELECT h.*, target, coalesce(sum(3::DOUBLE * size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS used,
        sum(w * size * n) OVER (PARTITION BY h.source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rest FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
x AS (SELECT source, max_by((target - used) / rest, size) AS lam FROM v WHERE (target - used) / rest * w <= 3::DOUBLE GROUP BY source),
m AS (SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target,
        CASE WHEN d.size > 0 THEN least(3::DOUBLE, coalesce(lam, 'inf'::DOUBLE) * sqrt(d.size::DOUBLE)) ELSE 0::DOUBLE END AS mean
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source),
p AS (SELECT *, floor(mean + 1e-9::DOUBLE) AS whole, greatest(mean - floor(mean + 1e-9::DOUBLE), 0::DOUBLE) AS f FROM m),
q AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS need, (u * (1 - f)) / ((1 - u) * f) AS q FROM p),
r AS (SELECT *, sum(CASE WHEN f > 1e-9::DOUBLE THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN f > 1e-9::DOUBLE THEN floor(q / (1 + q) * 1099511627776::DOUBLE) END NULLS FIRST, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST((whole + CASE WHEN f > 1e-9::DOUBLE AND need > 0 AND (run <= need OR run - need < need - run + size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
