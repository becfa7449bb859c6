"""Queries against their SQL, and against brute force where SQL cannot express them."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstack.llm import decontaminate
from loomstack.llm import queries as llm
from tests.conftest import FIXTURES


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_against_sql(spark, agree, name):
    agree(llm.QUERIES[name](spark, FIXTURES), llm.ORACLE[name])


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FIXTURES}/documents.parquet").collect()}


def test_op4_against_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in llm.QUERIES["op4_token_count"](spark, FIXTURES).collect():
        text = docs[r.doc_id].text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(t.encode(text, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 2048)


def test_op7_held_out_accuracy(spark, docs):
    rows = [r for r in llm.QUERIES["op7_language_id"](spark, FIXTURES).collect() if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in rows)
    assert len(rows) >= 20 and right / len(rows) >= 0.97


def test_op9_against_all_windows(spark, docs):
    words = lambda s: [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (s or "").lower()) if x]
    shingles = lambda w: Counter(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else Counter([tuple(w)])
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{FIXTURES}/benchmark.parquet").collect()}
    want = {}
    for d, r in docs.items():
        w = words(r.text)
        have = set(shingles(w))
        for k, item in items.items():
            a = shingles(item)
            if not have & set(a):
                continue
            for s in range(len(w) - len(item) + 1):
                b = shingles(w[s : s + len(item)])
                common = sum((a & b).values())
                score = common / (sum(a.values()) + sum(b.values()) - common)
                if score >= 0.8 and score > want.get((d, k), (0, 0))[1]:
                    want[d, k] = (s, round(score, 6))
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in llm.QUERIES["op9_decontaminate"](spark, FIXTURES).collect()}
    assert got == want


def test_every_query_reads_remote_like_paths(spark):
    assert llm.QUERIES["op1_pareto_mix"](spark, f"file://{FIXTURES}").where(F.col("taken") > 3 * F.col("size")).count() == 0


def test_op9_texts_shorter_than_an_item(spark):
    """Cut items against brute force over all windows, of which the whole text is one if the item is longer."""
    rng = random.Random(5)
    items = {k: [f"w{rng.randint(0, 400)}" for _ in range(n)] for k, n in enumerate([3, 5, 6, 9, 14, 30, 50, 50, 120])}
    texts = [w[:j] + w[j + d :] for w in items.values() for d in (1, 2, 5, 9) for j in sorted({0, 1, len(w) // 2, len(w) - d}) if 0 <= j < len(w)] + [[], ["w1"]]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for d, w in enumerate(texts):
        for k, item in items.items():
            for s in range(max(1, len(w) - len(item) + 1) if w else 0):
                a, b = grams(item), grams(w[s : s + len(item)])
                score = sum((a & b).values()) / sum((a | b).values())
                if score >= 0.8 and score > want.get((d, k), (0, 0, 0))[2]:
                    want[d, k] = (s, len(w[s : s + len(item)]), score)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.find_leaks(docs, table).collect()}
    assert got == want and any(len(texts[d]) == 49 and len(items[k]) == 50 for d, k in want)
    assert {r.doc_id for r in decontaminate.without_leaks(docs, table).collect()} == set(range(len(texts))) - {d for d, _ in want}
