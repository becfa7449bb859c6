"""Properties that hold for any input."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstack.operators import chunks, graph, metrics, search, snapshot

SOME = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LINES = st.lists(st.sampled_from(["", "  ", "x = 1;", "// c", "# d", "/* a", "b */", "/* one */", "if (a) {", "}", "} else {", "for (;;) { f(); }", "catch (e) {", "a && b || c"]), max_size=30)


def fold_lines(lines):
    code = comments = blank = 0
    inside = False
    for line in lines:
        s = line.strip()
        if not s:
            blank += 1
        elif s.startswith("/*"):
            inside, comments = not s.endswith("*/"), comments + 1
        elif inside:
            inside, comments = "*/" not in s, comments + 1
        elif s.startswith(("//", "#")):
            comments += 1
        else:
            code += 1
    return len(lines), code, comments, blank


@SOME
@given(st.lists(LINES, min_size=1, max_size=12))
def test_line_counts(spark, cases):
    rows = spark.createDataFrame([(i, "\n".join(c)) for i, c in enumerate(cases)], "i int, content string")
    got = {r.i: tuple(r.loc)[:4] for r in rows.select("i", metrics.line_counts(F.col("content")).alias("loc")).collect()}
    assert got == {i: fold_lines("\n".join(c).split("\n")) for i, c in enumerate(cases)}


@SOME
@given(st.lists(st.text("{}a\n", max_size=40), min_size=1, max_size=12))
def test_nesting(spark, cases):
    def deepest(s):
        at = most = 0
        for c in s:
            at = at + 1 if c == "{" else max(0, at - 1) if c == "}" else at
            most = max(most, at)
        return most

    rows = spark.createDataFrame(list(enumerate(cases)), "i int, content string")
    assert {r[0]: r[1] for r in rows.select("i", metrics.max_nesting(F.col("content"))).collect()} == {i: deepest(s) for i, s in enumerate(cases)}


@SOME
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.sampled_from(["0", "h1", "h2", "h3"])), st.dictionaries(st.sampled_from("abcdefgh"), st.sampled_from(["0", "h1", "h2", "h3"])))
def test_diff_and_its_inverse(spark, a, b):
    x, y = (spark.createDataFrame(list(d.items()), "path string, content_hash string") for d in (a, b))
    there = {(r.type, r.path, r.old_path) for r in snapshot.diff(x, y).collect()}
    back = {(r.type, r.path, r.old_path) for r in snapshot.diff(y, x).collect()}
    swap = {"added": "deleted", "deleted": "added"}
    assert back == {(swap.get(t, t), p, None) if t != "renamed" else (t, o, p) for t, p, o in there}
    assert not snapshot.diff(x, x).count()


def test_bm25_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(f"d{i}", " ".join(rng.choice(["graph", "node", "edge", "search"]) for _ in range(20))) for i in range(50)], "doc_id string, content string")
    a, b = (search.bm25(d, "graph search graph").collect() for d in (docs.coalesce(1), docs.repartition(7)))
    assert a == b


def test_reach_grows_with_depth(spark):
    rng = random.Random(4)
    e = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(80)], "src int, dst int")
    seed = spark.createDataFrame([(0,)], "id int")
    a, b = ({(r.id, r.depth) for r in graph.reach(e, seed, k).collect()} for k in (2, 4))
    assert a <= b and (0, 0) in a


def test_chunks_cover_all_lines(spark):
    rng = random.Random(6)
    text = "\n".join(" ".join("word" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))) for _ in range(120))
    got = chunks.sliding_chunks(spark.createDataFrame([("a", text)], "file_path string, content string"), least=1).collect()
    assert {i for r in got for i in range(r.start_line, r.end_line + 1)} == set(range(1, 121))
