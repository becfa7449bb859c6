"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing names; and brute force on planted cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomstack.llm import chat, decontaminate, language_id, line_dedup, mixing, near_dup, quality, substring_dedup, token_count, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "the cat sat on the mat and the dog lay by the door while rain fell on the old roof all night long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
    return frame(spark, [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "12 34 !?", "en", "b", 8), (5, TEXT, "en", "b", 1), (5, TEXT, "en", "b", 1), (None, TEXT, "en", None, 1), (7, long, "en", "b", 1), (8, "naïve Ünïcode 日本語 🙂 ﬁ", "fr", "c", 1)])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_mixing(spark, odd, none):
    out = mixing.mix_sources(odd, mixing.cyclic_weights(odd), keep_text=True)
    assert out.count() == 9 and "text" in out.columns
    rows = out.collect()
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert {r.source: r.target for r in rows}["a"] == 0
    assert mixing.mix_sources(none, mixing.cyclic_weights(none)).count() == 0
    clash = odd.withColumns({c: F.lit("x") for c in ("size", "taken", "weight", "f", "whole", "need", "end", "run", "c1", "Copies")})
    assert dict(mixing.mix_sources(clash, mixing.cyclic_weights(clash), keep_text=True).dtypes)["taken"] == "bigint"


def test_mixing_targets_and_reruns(spark):
    rng = random.Random(3)
    docs = frame(spark, [(i, "w " * rng.randint(1, 40), None, rng.choice(["a", "a", "a", "b", None]), 0) for i in range(3000)])
    runs = [mixing.mix_sources(d, mixing.cyclic_weights(d)) for d in (docs, docs.repartition(7))]
    a, b = (sorted((r.doc_id, r.taken) for r in x.collect()) for x in runs)
    assert a == b
    for r in runs[0].groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect():
        assert abs(r.n - r.t) <= 20
    # Inclusion grows with the root of the size, in the source that is not taken three times whole.
    share = runs[0].where("target < 2 * source_size").groupBy(F.col("size") > 20).agg(F.avg("copies")).collect()
    small, large = (r[1] for r in sorted(share))
    assert large > 1.3 * small
    flat = mixing.mix_sources(docs, mixing.cyclic_weights(docs), measure=mixing.even).where("target < 2 * source_size").groupBy(F.col("size") > 20).agg(F.avg("copies")).collect()
    assert abs(flat[0][1] - flat[1][1]) < 0.1


@pytest.mark.parametrize("keep_text", [False, True])
def test_mixing_takes_a_part_of_equal_rows(spark, keep_text):
    """1000 rows of one id and text, and 1000 rows without an id."""
    docs = frame(spark, [(i and 7, "w w w", None, s, 0) for s, i in (("a", 1), ("b", None)) for _ in range(1000)] + [(k, "w " * 50, None, "c", 0) for k in range(30)]).repartition(5)
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.7), ("c", 4.0)], "source string, weight double")
    for r in mixing.mix_sources(docs, weights, keep_text=keep_text).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.max(F.col("taken") / F.col("size")).alias("most")).collect():
        assert abs(r.n - r.t) <= (25 if r.source == "c" else 1.5) and r.most <= 3


def test_cyclic_weights(spark):
    rng = random.Random(6)
    names = [None, "", "é", "Z", "a", *(f"s{rng.random()}" for _ in range(200))]
    docs = frame(spark, [(i, "", None, names[i % len(names)], 0) for i in range(500)]).repartition(6)
    want = {s: i % 3 + 1 for i, s in enumerate([*sorted(n for n in names if n is not None), None])}
    assert {r.source: r.weight for r in mixing.cyclic_weights(docs).collect()} == want


def brute_repeats(texts, n=100):
    """Kept bytes by definition: every 100-byte string that starts earlier."""
    seen, out = set(), {}
    for d in sorted(texts):
        t, gone = texts[d], bytearray(len(texts[d]))
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        out[d] = bytes(c for c, g in zip(t, gone) if not g)
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "be", "gamma", "delta", "é", "zeta", "eta", "日本"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passage = text(40)
    texts = {i: text(rng.randint(0, 60)) + (passage[: rng.randint(50, len(passage))] if rng.random() < 0.6 else "") + text(5) for i in range(60)}
    texts |= {60: texts[3], 61: "a" * 700, 62: "ab" * 400, 63: "a" * 99, 64: "", 65: passage + passage}
    got = {r.id: r for r in substring_dedup.remove_repeats(frame(spark, [(k, v, None, None, 0) for k, v in texts.items()]).repartition(5), with_text=True).collect()}
    want = brute_repeats({k: v.encode() for k, v in texts.items()})
    assert {k: bytes(r.kept) for k, r in got.items()} == want
    assert all(r.n_removed == r.n_bytes - len(want[k]) and r.kept_sha256 == hashlib.sha256(want[k]).hexdigest() for k, r in got.items())


def test_substrings_long_text_and_edges(spark, odd, none, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_BLOCK", 4096)
    rng = random.Random(9)
    a = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000)).decode()
    texts = {1: a, 2: a[3000:12_000] + "x" + a[100:9000]}
    import numpy as np

    buf = np.frombuffer(texts[1].encode(), np.uint8)
    trigger, phrase, first, stop = substring_dedup.parse(buf, np.array([0, len(buf)]))
    assert (np.sort(np.concatenate([np.arange(x, y) for x, y in zip(first, stop)])) == np.arange(len(buf) - 99)).all()
    assert substring_dedup.remove_repeats(none).count() == 0
    rows = {(r.id, r.n_bytes): r for r in substring_dedup.remove_repeats(odd).collect()}
    assert rows[1, 0].n_removed == 0 and rows[2, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert substring_dedup.remove_repeats(odd).agg(F.sum("n_removed")).first()[0] > 0


def test_substring_rows_follow_entries(spark, monkeypatch):
    """Rows of every step are the same for any number of partitions, and wide triggers give the same result."""
    rng = random.Random(4)
    shared = " ".join(f"word{rng.randint(0, 99)}" for _ in range(60))
    docs = frame(spark, [(i, f"{rng.random()} {shared} {rng.random()} " * 2, None, None, 0) for i in range(60)] + [(None, shared, None, None, 0)] * 2).repartition(6).cache()
    counts = []

    class Counted(substring_dedup.Table):
        def __init__(self, df, tag, rows=None):
            super().__init__(df, tag, rows)
            counts[-1][tag] = self.df.count()

    monkeypatch.setattr(substring_dedup, "Table", Counted)
    results, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for parts, wide in ((4, 1 << 15), (40, 1 << 15), (4, 1)):
        counts.append({})
        monkeypatch.setattr(substring_dedup, "WIDE", wide)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(str, substring_dedup.remove_repeats(docs).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counts[0] == counts[1] and results[0] == results[1] == results[2]
    assert counts[0]["wide"] == 0 < counts[2]["wide"] and counts[0]["pieces"] > 60


def test_suffix_ranks():
    import numpy as np

    rng = random.Random(2)
    text = bytes(rng.choice(b"ab") for _ in range(700)) + bytes(150) + b"b" * 120
    for depth in (8, 13, 64, 100):
        rank = substring_dedup.suffix_ranks(np.frombuffer(text, np.uint8), depth)
        cut = [text[i : i + depth] for i in range(len(text) - depth)]
        order = sorted(range(len(cut)), key=cut.__getitem__)
        assert all((rank[a] == rank[b]) == (cut[a] == cut[b]) and rank[a] <= rank[b] for a, b in zip(order, order[1:]))


def test_quality(spark, odd, none):
    m = quality.with_measures(odd.withColumn("n_words", F.lit("clash")))
    rows = m.collect()
    assert [r.n_words for r in rows if r.text is None] == [0]
    out = quality.quality_cascade(m, skip=F.col("n_words") < 5)
    assert out.count() == 9 and not out.where("text is null").first().kept
    assert quality.quality_cascade(quality.with_measures(none)).count() == 0
    junk = frame(spark, [(1, "buy now cheap\n" * 30, None, None, 0), (2, "%%% $$$ ###" * 20, None, None, 0), (3, TEXT, None, None, 0), (4, (TEXT + ".\n").upper(), None, None, 0)])
    assert {r.doc_id: r.kept for r in quality.quality_cascade(quality.with_measures(junk)).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_repeated_words_by_hand(spark):
    w = [f"w{i}" for i in range(20)]
    cases = {1: w, 2: w[:8] + w[:8], 3: w[:9] + w[:9], 4: ["a"] * 20, 5: w[:7] * 2}
    want = {1: 0, 2: 16, 3: 18, 4: 20, 5: 0}

    def brute(ws):
        grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)})

    got = {r.doc_id: r.n_repeat_words for r in quality.with_measures(frame(spark, [(k, " ".join(v), None, None, 0) for k, v in cases.items()])).collect()}
    assert got == {k: brute(v) for k, v in cases.items()} and got[4] == want[4]


def test_tokens(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = token_count.count_tokens(odd.withColumn("n_tokens", F.lit("clash")), path)
    assert all(r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids) for r in out.collect())
    assert token_count.count_tokens(none, path).count() == 0
    counter = token_count.WordTokenCounter(path, token_count.proved_tokens(path))
    rng = random.Random(1)
    alphabet = "aBcÉüİıſK'sßſ½²٣ \t\n\x1c\x85\xa0日本é🙂_-." + "".join(map(chr, range(0xA0, 0x260)))
    for text in ["<|endoftext|> a", "I'm we've can't", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(3000))]:
        assert counter.count(text) == counter.whole(text), repr(text)


def brute_components(texts, percent):
    sets = {}
    for k, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in texts}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(spark, percent):
    rng = random.Random(percent)
    text = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    base, texts = text(120), {}
    for i in range(120):
        w = list(base) if i % 2 else text(rng.randint(3, 150))
        for _ in range(rng.randint(0, 6) if i % 2 else 0):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        texts[i] = " ".join(w)
    texts |= {200: texts[1].upper(), 201: "", 202: "one two", 203: "One  Two", 204: "x " * 50}
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, [(k, v, None, None, 0) for k, v in texts.items()]), percent=percent).collect()}
    assert got == brute_components(texts, percent)


def test_near_duplicates_take_small_batches(spark, monkeypatch):
    """12 MB of texts in one partition never come to a Python worker at once, and the session's setting comes back."""
    real = near_dup._signatures

    def checked(col):
        assert col.nbytes < 6 << 20
        return real(col)

    monkeypatch.setattr(near_dup, "_signatures", checked)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat(id % 1500, repeat(' abc', 1000)) AS text")
    out = near_dup.near_duplicates(docs)
    assert out.where("head").count() == 1500 and out.count() == 3000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_near_duplicates_edges(spark, odd, none):
    assert near_dup.near_duplicates(none).count() == 0
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == 9
    assert {r.component_id for r in rows if r.n_shingles == len({tuple(TEXT.split()[i : i + 5]) for i in range(len(TEXT.split()) - 4)})} == {5}


def test_lines(spark, odd, none):
    boiler = "this line of boilerplate text has more than ten words in it indeed"
    docs = frame(spark, [(1, f"a\n{boiler}\nb", None, None, 0), (2, f"{boiler}\n\nc", None, None, 0), (3, None, None, None, 0), (4, "a\nb\nc", None, None, 0), (5, "a\nb\nc", None, None, 0), (6, f"{boiler}\n{boiler}", None, None, 0)])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs) for r in line_dedup.dedup_lines(docs.withColumn("n_runs", F.lit("clash"))).collect()}
    assert got[1][0] == f"a\n{boiler}\nb" and got[2] == ("\nc", 3, 1, 1) and got[3] == (None, 0, 0, 0)
    assert got[4][2] == got[5][2] == 0 and got[6] == ("", 2, 2, 1)
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.dedup_lines(odd).count() == 9


def test_short_lines_go_in_long_runs(spark):
    run = "\n".join(f"line number {i}" for i in range(8))
    docs = frame(spark, [(1, run + "\nx", None, None, 0), (2, "y\n" + run, None, None, 0)])
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {1: run + "\nx", 2: "y"}


def test_language(spark, odd, none):
    model = language_id.train_language_model(odd)
    out = language_id.predict_language(odd.withColumn("lang_pred", F.lit(1)), model).collect()
    assert all(r.lang_pred == "und" and r.lang_score == 0 for r in out if r.text is None or not any(c.isalpha() for c in r.text))
    assert all(0 <= r.lang_score <= 1 for r in out)
    assert {r.lang_pred for r in language_id.predict_language(odd, language_id.train_language_model(none)).collect()} == {"und"}
    assert language_id.predict_language(none, model).count() == 0


def test_language_against_dictionaries(spark):
    """Naive Bayes with n-grams in dictionaries, hashed as in the operator; scores with the background."""
    import math
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(12)
    words = {"aa": ["lorem", "ipsum", "Dolor", "é"], "bb": ["zwei", "drei", "vier", "ÜBER"], "cc": ["uno", "dos", "tres", "日本"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 30))), k, None, 0) for i, k in enumerate(rng.choice(list(words)) for _ in range(150))]
    model = language_id.train_language_model(frame(spark, rows), buckets=1 << 10)

    def grams(text):
        low = "".join(c.lower() if c.isalpha() else " " if ord(c) < 0x250 else c for c in text)
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                h = 0
                for k, c in enumerate(low[i : i + n], 1):
                    h = (h * 0x01000193 + (ord(c) + k * 131) * 0x9E3779B1) % (1 << 32)
                yield (h * 0x85EBCA6B % (1 << 32)) >> 22

    counts, docs = {k: Counter() for k in words}, Counter(r[2] for r in rows)
    for r in rows:
        counts[r[2]].update(grams(r[1]))
    logp = lambda k, g: math.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * 1024))
    texts = [*(r[1] for r in rows[:40]), "lorem zwei uno", "xqxqxq", "日本", "a"]
    best, score, known = language_id.score_texts(pa.array(texts), model)
    for t, b, s in zip(texts, best, score):
        g = list(grams(t))
        total = {k: sum(logp(k, x) for x in g) for k in words}
        want = max(words, key=lambda k: total[k] + math.log(docs[k] / len(rows)))
        assert model.langs[b] == want
        scale = min(1, language_id.EVIDENCE / len(g))
        odds = {k: math.exp(total[k] * scale + math.log(docs[k] / len(rows) * 3 / 4)) for k in words}
        assert math.isclose(s, odds[want] / (sum(odds.values()) + math.exp(-len(g) * math.log(1024) * scale) / 4), rel_tol=1e-6)
    assert known[texts.index("xqxqxq")] < 0.5 < known[0] and known[texts.index("lorem zwei uno")] > 0.99


def test_language_of_many_labels(spark):
    docs = frame(spark, [(i, f"text number {i}", f"l{i % 600}", None, 0) for i in range(1200)])
    model = language_id.train_language_model(docs)
    assert len(model.langs) == 600 and model.logp.size <= (language_id.MATRIX + 600)


def test_chat(spark):
    t = lambda *xs: [{"role": r, "text": x} for r, x in xs]
    pairs = spark.createDataFrame(
        [(1, t(("user", "q"), ("assistant", "good")), t(("user", "q"), ("assistant", "bad"))), (2, t(("user", "q")), t(("user", "q"))), (3, None, t(("assistant", None))), (4, [], [])],
        f"id int, chosen {chat.TURNS}, rejected {chat.TURNS}",
    )
    out = {r.id: r for r in chat.format_preferences(pairs).collect()}
    assert out[1].prompt == "<|user|>\nq<|end|>\n" and out[1].n_prompt_turns == 1
    (s,) = out[1].chosen_spans
    assert out[1].chosen_completion[s.start : s.end] == "good<|end|>\n"
    assert out[2].chosen_completion == "" and out[2].n_prompt_turns == 1
    assert out[3].prompt == "" and out[3].rejected_completion == "<|assistant|>\n<|end|>\n" and out[4].prompt == ""
    turns = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None)], "conv_id int, turn int, role string, text string")
    assert {r.conv_id: len(r.turns) for r in chat.gather_turns(turns).collect()} == {1: 3, 2: 1}


def test_chat_of_many_turns_and_edges(spark):
    import time

    many = [{"role": "assistant" if i % 2 else "user", "text": f"turn {i}"} for i in range(5000)]
    pairs = spark.createDataFrame([(1, many, [*many[:-1], {"role": "assistant", "text": "x"}], "clash"), (2, [many[0]], many, "clash")], f"id int, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string")
    begun = time.perf_counter()
    out = {r.id: r for r in chat.format_preferences(pairs).collect()}
    assert time.perf_counter() - begun < 30
    assert out[1].n_prompt_turns == 4999 and out[1].rejected_completion == "<|assistant|>\nx<|end|>\n" and len(out[2].rejected_spans) == 2500
    assert all(out[2].rejected_completion[s.start : s.end] == f"turn {2 * i + 1}<|end|>\n" for i, s in enumerate(out[2].rejected_spans))
    assert out[2].prompt == "<|user|>\nturn 0<|end|>\n" and chat.format_preferences(pairs.limit(0)).count() == 0


def test_leaks(spark, odd, none):
    items = spark.createDataFrame([(1, TEXT), (2, None), (3, "..."), (4, "w1 x1"), (5, TEXT)], "item_id long, text string")
    docs = odd.select("doc_id", "text").union(frame(spark, [(20, "intro words here " + TEXT.replace("roof", "house") + " and outro", None, None, 0), (21, TEXT[:40], None, None, 0), (22, TEXT.upper() + "!", None, None, 0)]).select("doc_id", "text"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert {(5, 1), (5, 5), (None, 1), (None, 5), (7, 4), (22, 1), (22, 5)} <= got and not any(d in (1, 2, 3, 4, 21) for d, _ in got)
    clean = {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()}
    assert 5 not in clean and 22 not in clean and {1, 2, 3, 4, 21} <= clean
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(i, f"{TEXT} number {i} " + " ".join(f"z{i}{k}" for k in range(30))) for i in range(5)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("pre "), "text").alias("text"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect() if r.similarity == 1} == {(i, i) for i in range(5)}
    assert decontaminate.without_leaks(docs, items).count() == 0


def test_hamming_index_finds_all(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    q = a[rng.integers(0, 200, 300)]
    for i in range(len(q)):
        for b in rng.choice(64, rng.integers(0, 30), replace=False):
            q[i] ^= np.uint64(1) << np.uint64(b)
    got = set(zip(*(x.tolist() for x in decontaminate.HammingIndex(a).query(q))))
    assert got == {(i, j) for i in range(300) for j in range(200) if int(q[i] ^ a[j]).bit_count() <= decontaminate.RADIUS}


def test_hamming_index_prunes_and_recalls():
    """Share of items that a window is compared with, and of windows at 0.8 to 0.85 that the radius keeps."""
    import numpy as np

    rng = np.random.default_rng(3)
    index = decontaminate.HammingIndex(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    tried = sum(len(q) for q, _ in index.candidates(rng.integers(0, 1 << 63, 50, dtype=np.uint64)))
    assert tried < 0.14 * 50 * 20_000
    prints = lambda w: decontaminate._prints(decontaminate._sums(decontaminate._grams(w, 5)), np.zeros(1, np.int64), len(w) - 4)[0]
    near = kept = 0
    for _ in range(3000):
        a = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        b = a.copy()
        b[rng.integers(0, 60, rng.integers(1, 3))] = rng.integers(0, 1 << 63)
        if 0.8 <= decontaminate.weighted_jaccard(decontaminate._grams(a, 5), decontaminate._grams(b, 5)) < 0.87:
            near += 1
            kept += int(prints(a) ^ prints(b)).bit_count() <= decontaminate.RADIUS
    assert near > 500 and kept / near > 0.995


def test_warc_round_trip(spark, tmp_path):
    html = lambda i: f"<html>{'common part ' * 20}{i}</html>"
    pages = spark.createDataFrame([(i, f"http://x/{i}", html(i % 7)) for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "a b\n", "ü" * 70_000), (None, "n", html(3))], "page_id long, url string, html string")
    table = warc.write_archives(pages)
    back = warc.read_archives(table.df, with_payload=True).collect()
    assert len(back) == 44
    want = {}
    for r in pages.collect():
        want.setdefault(r.html or "", []).append(r.page_id)
    for r in back:
        if r.record_type == "response":
            assert warc.payload_digest(bytes(r.payload)) == r.payload_digest and len(r.payload) == r.payload_bytes
            assert int(r.id) == max(i for i in want[bytes(r.payload).decode()] if i is not None)
    assert sum(r.record_type == "response" for r in back) == 9 and {r.refers_to for r in back if r.id == "null"} == {"38"}
    assert warc.save_archives(table.df, f"file://{tmp_path}") >= 1
    files = list(tmp_path.glob("*.warc.zst"))
    assert sum(len(list(warc.read_archive(f.read_bytes()))) for f in files) == 44
    assert warc.read_archives(warc.write_archives(pages.limit(0)).df).count() == 0
