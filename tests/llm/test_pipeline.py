"""Each stage of the pipeline held against brute force on a small corpus."""

import random
import re
from pathlib import Path

import corpus_pipeline as cp
from pyspark.sql import functions as F

from loomstack.llm import near_dup
from tests.conftest import FIXTURES
from tests.llm.test_edges import SCHEMA, brute_components


def corpus(spark):
    docs = spark.read.parquet(f"{FIXTURES}/documents.parquet")
    return docs.union(spark.createDataFrame([(9000, None, None, None, None), (9001, "123 !!", "en", "a", 6), (9002, "", None, None, 0)], SCHEMA))


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "mix"]


def test_language_keeps_clean_documents(spark):
    docs = corpus(spark)
    out = cp.language(spark, docs, FIXTURES)
    assert out.columns == docs.columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in out.select("doc_id").collect()} == {9000, 9001, 9002}


def test_language_rejects_texts_in_no_known_language(spark):
    docs = corpus(spark).union(spark.createDataFrame([(9100, "Это предложение написано на русском языке", None, None, 1), (9101, "xqzvk wvqjx kzzqw vjxqk zwqvx jkqzx " * 5, "en", "a", 1)], SCHEMA))
    assert not {9100, 9101} & {r.doc_id for r in cp.language(spark, docs, FIXTURES).collect()}


def test_lines_take_effect(spark):
    a, b = "first line with quite a few words that nobody else has", "shared line with more than ten words that comes back again here"
    docs = spark.createDataFrame([(1, f"{a}\n{b}", "en", "s", 1), (2, f"{b}\nown words", "en", "s", 1), (3, b, "en", "s", 1)], SCHEMA)
    assert {r.doc_id: (r.text, r.n_chars) for r in cp.lines(spark, docs, FIXTURES).collect()} == {1: (f"{a}\n{b}", 1), 2: ("own words", 9)}


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    texts = {i: " ".join(base if i % 3 else [f"q{rng.random()}" for _ in range(40)]) + (f" tail{i}" if i % 2 else "") for i in range(30)}
    rows = [(k, v, "en", "s", 1) for k, v in texts.items()]
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[1], "en", "s", 1), (None, "alone in the world of words", "en", "s", 1)], SCHEMA)
    got = sorted(r.doc_id for r in cp.near_duplicates(spark, docs, FIXTURES).collect() if r.doc_id is not None)
    want = brute_components(texts, 80)
    kept_null = [r.text for r in cp.near_duplicates(spark, docs, FIXTURES).collect() if r.doc_id is None]
    heads = sorted(k for k, (_, c) in want.items() if k == c)
    assert got == heads and kept_null == ["alone in the world of words"]


def test_an_id_with_several_texts(spark):
    """One id for different texts, near copies under one id, and texts without an id."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, a), (2, b), (2, a[:-1] + ["x"]), (5, a), (2, b[:-1] + ["y"]), (None, a[:-1] + ["z"]), (None, [f"n{i}" for i in range(60)]), (None, [f"n{i}" for i in range(59)] + ["m"])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], SCHEMA)
    kept = [(r.doc_id, r.text.split()[0]) for r in cp.near_duplicates(spark, docs, FIXTURES).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a0"), (2, "b0"), (None, "n0")], key=str)
    found = sorted(((r.id, r.component_id) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(1, 1), (2, 2), (2, 1), (5, 1), (2, 2), (None, 1), (None, None), (None, None)], key=str)


def test_benchmark_and_mix(spark):
    items = spark.read.parquet(f"{FIXTURES}/benchmark.parquet").collect()
    docs = spark.createDataFrame([(1, "before " + items[0].text + " after", "en", "s", 1), (2, "nothing of the kind is in here at all", "en", "s", 1), (3, None, "en", None, 1)], SCHEMA)
    out = cp.benchmark(spark, docs, FIXTURES)
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]
    mixed = cp.mix(spark, out, FIXTURES)
    assert set(docs.columns) <= set(mixed.columns) and [r.doc_id for r in mixed.collect()] == [2]


def test_run(spark):
    out = cp.run(spark, FIXTURES)
    assert out.where(F.col("copies") < 1).count() == 0 and out.count() > 50


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, FIXTURES)
    assert docs.count() == 0


def test_stages_begin_without_free_native_memory(spark):
    """What the JVM's C allocator holds free between blocks in use is given back before a stage, each of them."""
    jvm = spark._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    blocks = [jvm.java.util.zip.Deflater() for _ in range(1600)]  # 0.26 MB of native memory each, touched in part
    begun = cp.trimmed(lambda spark, docs, sf_dir: docs)
    for i, block in enumerate(blocks):
        if i % 20:
            block.end()
    before = held()
    begun(spark, None, FIXTURES)
    after = held()
    for block in blocks[::20]:
        block.end()
    assert before - after > 40
    assert all(f.__wrapped__ is getattr(cp, name) for name, f in cp.STAGES)
