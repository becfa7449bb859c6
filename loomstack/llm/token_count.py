"""Token counts by whole-token shortcut.

``proved_tokens`` proves, on the driver and without any corpus, which
vocabulary strings a tokenizer encodes alone as exactly one token.  On
executors a text is normalised and cut into pre-tokens; a pre-token in the
proved set counts 1 by one dictionary lookup, any other is merged by the
library (its count is remembered in a bounded cache).  BPE merges never cross
pre-tokens, so the sum is the library's count.

The plain-text path covers texts of ASCII and Latin letters up to U+024F
without combining marks or case pairs of odd length; any other text, and any
that contains the string of an added token, is encoded as a whole by the
library, which is the definition of the result.

Edge cases: null and empty texts have 0 tokens; very long texts are counted
whole; repeated rows are counted each; columns named like the result are
replaced.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm.common import batch_udf, replace_columns

#: Pre-token pattern of the word tokenizer's file, for the safe characters below (fixed values).
WORD_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters on which normalisation is plain lower-casing and blanks are the same for all libraries.
SAFE = r"[\t\n\x0b\x0c\r\x20-\x7e¡-¬®-įĲ-ɏ]*"
#: Pre-tokens whose counts a worker remembers.
CACHE = 1 << 18


def proved_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are whole pre-tokens and that the tokenizer encodes alone as one token."""
    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    model = json.loads(t.to_str())["model"]
    end, whole = model.get("end_of_word_suffix") or "", regex.compile(WORD_PRETOKENS)
    back = {c: b for b, c in _byte_letters().items()}
    found = []
    for s in model["vocab"]:
        if end and not s.endswith(end):
            continue
        try:
            plain = bytes(back[c] for c in s[: len(s) - len(end)]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if plain and whole.fullmatch(plain) and plain == plain.lower():
            found.append(plain)
    return frozenset(s for s, e in zip(found, t.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenCounter:
    """Counts tokens of texts for a lower-casing BPE with word ends."""

    def __init__(self, path: str, proved: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = json.loads(self.library.to_str())["added_tokens"]
        self.added = re.compile("|".join(re.escape(a["content"]) for a in added) or r"(?!)")
        self.safe, self.cut = regex.compile(SAFE), regex.compile(WORD_PRETOKENS)
        self.proved, self.known = proved, _Counts(proved, self.library.model)

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.safe.fullmatch(text) or self.added.search(text):
            return self.whole(text)
        if len(self.known) > CACHE + len(self.proved):
            self.known = _Counts(self.proved, self.library.model)
        return sum(map(self.known.__getitem__, self.cut.findall(text.lower())))


class _Counts(dict):
    """Tokens of each pre-token: 1 for the proved ones, any other is merged by the library's model when first met."""

    def __init__(self, proved: frozenset[str], model):
        super().__init__(dict.fromkeys(proved, 1))
        self.model = model

    def __missing__(self, piece: str) -> int:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
        n = self[piece] = len(self.model.tokenize(letters))
        return n


_LETTERS = _byte_letters()
_counters: dict[str, WordTokenCounter] = {}


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """All columns of ``df`` and the number of tokens of ``text`` as the tokenizer file gives them."""
    proved = df.sparkSession.sparkContext.broadcast(proved_tokens(tokenizer))

    def counts(col: pa.Array) -> pa.Array:
        counter = _counters.get(tokenizer) or _counters.setdefault(tokenizer, WordTokenCounter(tokenizer, proved.value))
        return pa.array([counter.count(x.as_py()) for x in col], pa.int64())

    return replace_columns(df, [out]).withColumn(out, batch_udf(counts, "long")(F.col(text)))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document by the word tokenizer."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return n.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
