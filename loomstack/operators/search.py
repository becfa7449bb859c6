"""Full-text search: tokeniser, postings, BM25, graph boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.functions.fixed import BM25_B, BM25_K1, STOP_WORDS, TOKEN_GAP
from loomstack.functions.storage import Table


def tokenize(text: Column) -> Column:
    """Tokens of a text: parts of camelCase and snake_case words, then the word itself, lower-cased, without stop words."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), TOKEN_GAP, -1), lambda w: F.length(w) >= 2)

    none = F.array().cast("array<string>")

    def of_word(w: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(w, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
        parts = F.transform(F.split(spaced, r"[\s_]", -1), F.lower)
        good = F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.isin(STOP_WORDS) & ~p.rlike(r"^\d+\z"))
        whole = F.lower(w)
        plain = F.when(whole.isin(STOP_WORDS), none).when(whole.rlike(r"^\d+\z"), F.array(whole)).otherwise(F.array(whole, whole))
        split = F.concat(good, F.when((F.length(whole) >= 2) & ~whole.isin(STOP_WORDS), F.array(whole)).otherwise(none))
        # Most words have no place to be cut at; they skip the replacements and the split.
        return F.when(w.rlike("[a-z][A-Z]|[A-Z][A-Z][a-z]|_"), split).otherwise(plain)

    return F.flatten(F.transform(raw, of_word))


def index(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings (token, doc_id, tf) and statistics (doc_id, len) of every document."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), tokenize(F.col(text)).alias("tokens"))
    postings = tokens.select("doc_id", F.explode("tokens").alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return postings, tokens.select("doc_id", F.size("tokens").alias("len"))


def bm25(docs: DataFrame, question: str, id_col: str = "doc_id", text: str = "content", limit: int = 20) -> DataFrame:
    """(doc_id, score) of the best documents; a token repeated in the question counts again.

    The postings of the question's tokens are found while tokenising, so the
    full inverted index is never shuffled; only documents that match are.
    Lengths and hits are a narrow table, so texts are tokenised once.
    """
    spark = docs.sparkSession
    asked = spark.range(1).select(F.explode(tokenize(F.lit(question))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    tokens = docs.select(F.col(id_col).alias("doc_id"), tokenize(F.col(text)).alias("tokens"))
    words = [r[0] for r in asked.select("token").collect()]
    among = F.filter("tokens", lambda t: t.isin(words)) if words else F.array().cast("array<string>")
    sized = Table(tokens.select("doc_id", F.size("tokens").alias("len"), among.alias("hits")), "tokens").df
    tf = sized.where(F.size("hits") > 0).select("doc_id", "len", F.explode("hits").alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    return scored(tf, asked, sized).orderBy(F.desc("score"), "doc_id").limit(limit)


def scored(tf: DataFrame, asked: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, score) from postings with lengths (token, doc_id, tf, len), the question's tokens (token, times) and all lengths."""
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avgdl")))
    return tf.join(df, "token").join(asked, "token").crossJoin(F.broadcast(totals)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def search_code(files: DataFrame, dependents: DataFrame, question: str, limit: int = 20, stored: SearchIndex | None = None) -> DataFrame:
    """BM25 over contents, raised by (1 + 0.1 ln(1 + dependents)); ``dependents`` is (file_path, n), ``stored`` an index of the files."""
    top = (stored.search(question, 2 * limit) if stored else bm25(files, question, "file_path", "content", 2 * limit)).withColumnRenamed("doc_id", "file_path")
    boosted = top.join(dependents, "file_path", "left").withColumn("dependents", F.coalesce("n", F.lit(0)))
    score = F.round(F.col("score") * (1 + 0.1 * F.ln(1 + F.col("dependents"))), 6)
    best = boosted.select("file_path", score.alias("score"), "dependents").orderBy(F.desc("score"), "file_path").limit(limit)
    return best.join(files.select("file_path", F.substring_index("content", "\n", 5).alias("snippet")), "file_path")


def search_symbols(symbols: DataFrame, question: str, limit: int = 20) -> DataFrame:
    """BM25 over "name kind path" of symbols."""
    text = symbols.withColumn("content", F.concat_ws(" ", "name", "kind", "file_path"))
    return bm25(text, question, "id", "content", limit).withColumnRenamed("doc_id", "id").join(symbols.select("id", "name", "kind", "file_path"), "id")


class SearchIndex:
    """A stored inverted index: postings (token, doc_id, tf) and lengths (doc_id, len) as tables of the shared folder.

    Postings are written in ranges of tokens, so a question reads the files of
    its own tokens only; an update replaces the rows of the named documents.
    """

    def __init__(self, docs: DataFrame, id_col: str = "file_path", text: str = "content"):
        self.id_col, self.text = id_col, text
        self._store(*index(docs, id_col, text))

    def _store(self, postings: DataFrame, lengths: DataFrame) -> None:
        old = [getattr(self, k, None) for k in ("postings", "lengths")]
        self.postings = Table(postings.repartitionByRange("token").sortWithinPartitions("token"), "postings")
        self.lengths = Table(lengths, "lengths")
        for t in filter(None, old):
            t.drop()

    def update(self, docs: DataFrame) -> None:
        """Replace or add documents; a null text removes one."""
        named = docs.select(F.col(self.id_col).alias("doc_id")).distinct()
        postings, lengths = index(docs.where(F.col(self.text).isNotNull()), self.id_col, self.text)
        rest = lambda t: t.df.join(named, "doc_id", "left_anti")
        self._store(rest(self.postings).unionByName(postings), rest(self.lengths).unionByName(lengths))

    def stats(self) -> DataFrame:
        """(documents, tokens, mean_length)."""
        return self.lengths.df.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean_length"))

    def clear(self) -> None:
        self._store(self.postings.df.limit(0), self.lengths.df.limit(0))

    def search(self, question: str, limit: int = 20) -> DataFrame:
        """(doc_id, score) of the best documents, as ``bm25``."""
        spark = self.lengths.spark
        asked = spark.range(1).select(F.explode(tokenize(F.lit(question))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times"))
        words = [r[0] for r in asked.select("token").collect()]
        tf = self.postings.df.where(F.col("token").isin(words)).join(self.lengths.df, "doc_id")
        return scored(tf, asked, self.lengths.df).orderBy(F.desc("score"), "doc_id").limit(limit)
