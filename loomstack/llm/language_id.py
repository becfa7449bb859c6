"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all rows given to it (no sample): each task counts
into one array per language, Spark sums (lang, bucket) rows, and the result,
at most ``MAX_LANGS`` x ``buckets`` numbers, becomes a log-probability matrix
that is broadcast.  Scoring gathers matrix rows for a batch of texts in numpy
and adds them up per text.

The score is the posterior of the language against all others and against a
background in which every bucket is equally likely; ``known`` is the posterior
of all languages together, low for texts in none of them.  N-grams of one text overlap and repeat each other, so a
text counts as ``EVIDENCE`` of them at most: its mean log-likelihood times that.

Edge cases: a null or empty text, or one without a letter, is ``und`` with
score 0; without any labelled row all texts are ``und``; repeated rows count
each time; ties go to the language first by code point; columns named like
the results are replaced; very long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm.common import batch_udf, replace_columns, slices, text_buffer

UND = "und"
#: Bounds of the broadcast matrix: its numbers, and the languages that it must tell apart; with many, buckets are fewer.
MATRIX, MAX_LANGS = 1 << 24, 1 << 14
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: N-grams that a text counts as at most.
EVIDENCE = 64

_FOLD_TO = 0x250
_FOLD = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else (ord(c) if c.isalpha() else 32) for c in map(chr, range(_FOLD_TO))], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """langs in code-point order, log prior of each, and log P(bucket | lang)."""

    langs: tuple[str, ...]
    prior: np.ndarray
    logp: np.ndarray  # buckets + 1 rows, the last one zero
    orders: tuple[int, ...]

    @property
    def buckets(self) -> int:
        return len(self.logp) - 1


def _ngrams(buf: np.ndarray, offsets: np.ndarray, buckets: int, orders: tuple[int, ...]):
    """For each order: bucket of the n-gram that starts at each character (``buckets``: none), and the texts' first characters."""
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    low = np.where(chars < _FOLD_TO, _FOLD[np.minimum(chars, _FOLD_TO - 1)], chars)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(low))
    shift, h = np.uint32(32 - (buckets - 1).bit_length()), np.zeros(len(low), np.uint32)
    for n in range(1, max(orders) + 1):
        if n > len(low):
            break
        h = h[: len(low) - n + 1] * np.uint32(0x01000193) + (low[n - 1 :] + np.uint32(n * 131)) * np.uint32(0x9E3779B1)
        if n in orders:
            yield np.where(left[: len(h)] >= n, (h * np.uint32(0x85EBCA6B)) >> shift, buckets), at


def train_language_model(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> LanguageModel:
    """Count n-grams of every row with a text and a language."""

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            buf, off = text_buffer(b.column(0))
            names = b.column(1).to_pylist()
            kinds = {k: i for i, k in enumerate(dict.fromkeys(names))}
            code = np.array([kinds[k] for k in names])
            for i, j in slices(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                for grams, at in _ngrams(part, o, buckets, orders):
                    which = np.repeat(code[i:j], np.diff(at))[: len(grams)]
                    tally = np.bincount(which * (buckets + 1) + grams, minlength=len(kinds) * (buckets + 1)).reshape(-1, buckets + 1)
                    for k, n in kinds.items():
                        if k in seen:
                            seen[k] += tally[n]
                        else:
                            seen[k] = tally[n].astype(np.int64)
        for k, tally in seen.items():
            full = np.flatnonzero(tally[:buckets])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(tally[full])], ["lang", "bucket", "n"])

    rows = df.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    priors = {r[0]: r[1] for r in rows.groupBy("l").count().take(MAX_LANGS + 1)}
    if len(priors) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = tuple(sorted(priors))
    buckets = min(buckets, 1 << (MATRIX // max(1, len(langs))).bit_length() - 1)
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(langs), buckets))
    got = sums.toArrow()
    if len(got):
        index = {k: i for i, k in enumerate(langs)}
        table[[index[k] for k in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    logp = np.zeros((buckets + 1, len(langs)))
    logp[:-1] = (np.log(table + 0.5) - np.log(table.sum(1, keepdims=True) + 0.5 * buckets)).T
    total = max(1, sum(priors.values()))
    return LanguageModel(langs, np.array([np.log(priors[k] / total) for k in langs]), logp, orders)


def score_texts(col: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its score, and that of all languages together, for each text of an array."""
    buf, off = text_buffer(col)
    best, score, every = np.zeros(len(col), np.int64), np.zeros(len(col)), np.zeros(len(col))
    for i, j in slices(off):
        total, size = np.zeros((j - i, len(model.langs))), np.zeros(j - i, np.int64)
        part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        for n, (grams, at) in zip(model.orders, _ngrams(part, o, model.buckets, model.orders) if len(part) else (), strict=False):
            size += np.maximum(np.diff(at) - n + 1, 0)
            at = np.minimum(at, len(grams))
            full = np.flatnonzero(np.diff(at) > 0)
            for k in range(len(model.langs)):
                total[full, k] += np.add.reduceat(np.ascontiguousarray(model.logp[:, k])[grams], at[full])
        best[i:j] = (total + model.prior).argmax(1)
        # The background comes last; its prior is that of an even choice.
        known = len(model.langs)
        scale = np.minimum(1.0, EVIDENCE / np.maximum(size, 1))[:, None]
        prior = np.append(model.prior + np.log(known / (known + 1)), -np.log(known + 1))
        rated = np.column_stack([total, -size * np.log(model.buckets)]) * scale + prior
        rated -= rated.max(1, keepdims=True)
        rated = np.exp(rated)
        score[i:j] = rated[np.arange(j - i), best[i:j]] / rated.sum(1)
        every[i:j] = rated[:, :known].sum(1) / rated.sum(1)
    return best, score, every


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "lang_score", known: str = "lang_known") -> DataFrame:
    """All columns of ``df`` and the three results; only the text is an input."""
    spark = df.sparkSession
    kept = replace_columns(df, [pred, score, known])
    if not model.langs:
        return kept.withColumns({pred: F.lit(UND), score: F.lit(0.0), known: F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)

    def hits(col: pa.Array) -> pa.Array:
        k, s, e = score_texts(col, shared.value)
        return pa.StructArray.from_arrays([pa.array(k.astype(np.int32)), pa.array(s), pa.array(e)], ["k", "s", "e"])

    hit = "__language_hit"
    names = F.array(*[F.lit(x) for x in model.langs])
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return (
        kept.withColumn(hit, batch_udf(hits, "k int, s double, e double")(F.col(text)))
        .withColumn(pred, F.when(has_letter, names[F.col(f"{hit}.k")]).otherwise(UND))
        .withColumn(score, F.when(has_letter, F.col(f"{hit}.s")).otherwise(0.0))
        .withColumn(known, F.when(has_letter, F.col(f"{hit}.e")).otherwise(0.0))
        .drop(hit)
    )


def held_out(doc_id: Column) -> Column:
    """Rows on which no model may learn: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_language_model(docs.where(~held_out(F.col("doc_id"))))
    out = predict_language(docs.select("doc_id", "text"), model, score="score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
