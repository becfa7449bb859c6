"""Queries over relations derived from the fixture tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstack.functions import fixed
from loomstack.functions.storage import Table
from loomstack.operators import chunks, dead_code, duplication, graph, impact, library, metrics, parse, reports, rules, search, security, snapshot
from loomstack.plans.registry import query
from loomstack.sources import files as src
from loomstack.sources import fixtures as fx
from loomstack.streaming import watch

LAYERED = impact.Architecture([impact.Context("domain", ["/domain/"], ["/infrastructure/", "/utils/"]), impact.Context("application", ["/application/"], ["/infrastructure/"]), impact.Context("infrastructure", ["/infrastructure/"])])
QUESTION = "the getThe interface of haStore for with"
WITH_FILES = f"WITH files AS ({fx.FILES_SQL}), "
WITH_CODE = f"WITH files AS ({fx.CODE_FILES_SQL}), "
WITH_PAGES = f"WITH files AS ({fx.PAGE_FILES_SQL}), "
WITH_GRAPH = f"WITH RECURSIVE nodes AS ({fx.NODES_SQL}), edges AS ({fx.EDGES_SQL}), "
WITH_SYMBOLS = f"WITH symbols AS ({fx.SYMBOLS_SQL}), "
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(fixed.STOP_WORDS))
_GAP = fixed.TOKEN_GAP.replace("'", "''")


def _tokens(text: str) -> str:
    """DuckDB list of the tokens of a text."""
    return f"""flatten(list_transform(list_filter(regexp_split_to_array({text}, '{_GAP}'), lambda w: length(w) >= 2), lambda w: list_concat(
      list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s_]'), lambda p: lower(p)),
        lambda p: length(p) >= 2 AND p NOT IN ({_STOP}) AND NOT regexp_full_match(p, '[0-9]+')),
      CASE WHEN length(lower(w)) >= 2 AND lower(w) NOT IN ({_STOP}) THEN [lower(w)] ELSE [] END)))"""


def _bm25(source: str, id_col: str, text: str, limit: int) -> str:
    return f"""t AS (SELECT {id_col} AS id, {_tokens(text)} AS ts FROM {source}),
p AS (SELECT id, unnest(ts) AS token FROM t), tf AS (SELECT id, token, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT token, count(*) AS times FROM (SELECT unnest({_tokens("'" + QUESTION + "'")}) AS token) GROUP BY token), a AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
s AS (SELECT tf.id, round(sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / avgdl))), 6) AS score
      FROM tf JOIN df USING (token) JOIN q USING (token) JOIN t USING (id), a GROUP BY tf.id ORDER BY score DESC, id LIMIT {limit})"""


# --- search ---


@query("bm25_search", WITH_FILES + _bm25("files", "file_path", "content", 20) + " SELECT id AS doc_id, score FROM s")
def bm25_search(spark, d):
    return search.bm25(fx.files(spark, d), QUESTION, "file_path")


@query("tokenize", WITH_FILES + f"t AS (SELECT file_path, unnest({_tokens('content')}) AS token FROM files) SELECT file_path, token, count(*) AS tf FROM t GROUP BY ALL")
def tokenize(spark, d):
    postings, _ = search.index(fx.files(spark, d), "file_path", "content")
    return postings.select(F.col("doc_id").alias("file_path"), "token", "tf")


@query("search_symbols", WITH_SYMBOLS + _bm25("symbols", "id", "concat(name, ' ', kind, ' ', file_path)", 20).replace(QUESTION, "red widget class") + " SELECT id, score, name, kind FROM s JOIN symbols USING (id)")
def search_symbols(spark, d):
    return search.search_symbols(fx.symbols(spark, d), "red widget class").select("id", "score", "name", "kind")


_CODE_SEARCH = (
    f"WITH files AS ({fx.CODE_FILES_SQL}), deps AS (SELECT 'src/doc_' || (o_orderkey % (SELECT count(*) FROM documents)) || '.js' AS file_path, count(*) AS m FROM orders GROUP BY 1), "
    + _bm25("files", "file_path", "content", 40)
    + " SELECT id AS file_path, round(score * (1 + 0.1::DOUBLE * ln(1 + coalesce(m, 0))), 6) AS score, coalesce(m, 0) AS dependents FROM s LEFT JOIN deps ON deps.file_path = id ORDER BY 2 DESC, 1 LIMIT 20"
)


@query("search_code_boosted", _CODE_SEARCH)
def search_code_boosted(spark, d):
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    deps = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.concat(F.lit("src/doc_"), F.col("o_orderkey") % n, F.lit(".js")).alias("file_path")).agg(F.count(F.lit(1)).alias("n"))
    return search.search_code(fx.code_files(spark, d), deps, QUESTION).select("file_path", "score", "dependents")


# --- graph ---


@query("graph_stats", WITH_GRAPH + "x AS (SELECT 1) SELECT count(*) AS nodes, count(*) FILTER (WHERE type = 'file') AS file_nodes, count(*) FILTER (WHERE type <> 'file') AS symbol_nodes, (SELECT count(*) FROM edges) AS edges FROM nodes")
def graph_stats(spark, d):
    return graph.graph_stats(fx.edges(spark, d), fx.nodes(spark, d))


_NAMED = "SELECT n.file_path AS file, min_by(n.name, n.id) AS name, min_by(n.type, n.id) AS type FROM k JOIN nodes n ON n.id = k.id GROUP BY 1"


@query("dependents_of", WITH_GRAPH + "k AS (SELECT DISTINCT src AS id FROM edges WHERE dst = 7 AND src <> dst) " + _NAMED)
def dependents_of(spark, d):
    return graph.dependents_of(fx.edges(spark, d), fx.nodes(spark, d), 7)


@query("dependencies_of", WITH_GRAPH + "k AS (SELECT DISTINCT dst AS id FROM edges WHERE src = 7) " + _NAMED)
def dependencies_of(spark, d):
    return graph.dependencies_of(fx.edges(spark, d), fx.nodes(spark, d), 7)


@query("hub_files", WITH_GRAPH + "h AS (SELECT dst, count(DISTINCT src) AS dependents, count(*) AS edges FROM edges GROUP BY dst) SELECT file_path AS file, dependents, edges FROM h JOIN nodes ON id = dst ORDER BY 2 DESC, 1 LIMIT 10")
def hub_files(spark, d):
    return graph.hub_files(fx.edges(spark, d), fx.nodes(spark, d))


@query("orphan_files", WITH_GRAPH + "u AS (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 300000) SELECT id, file_path AS file FROM nodes WHERE type = 'file' AND id NOT IN (SELECT id FROM u)")
def orphan_files(spark, d):
    edges = spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 300000").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.orphan_files(edges, fx.nodes(spark, d))


@query("impact_of", WITH_GRAPH + "r AS (SELECT 7::BIGINT AS id, 0 AS depth UNION SELECT e.src, depth + 1 FROM r JOIN edges e ON e.dst = r.id WHERE depth < 5), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT id, file_path AS file, name, depth FROM m JOIN nodes USING (id) WHERE depth > 0")
def impact_of(spark, d):
    return graph.impact_of(fx.edges(spark, d), fx.nodes(spark, d), 7)


@query("transitive_dependencies", WITH_GRAPH + "r AS (SELECT 7::BIGINT AS id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN edges e ON e.src = r.id WHERE depth < 9) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0")
def transitive_dependencies(spark, d):
    return graph.transitive_dependencies(fx.edges(spark, d), 7)


@query("shortest_path")
def shortest_path(spark, d):
    out = graph.shortest_path(fx.edges(spark, d), 1, 100)
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "length")


_CYCLES = """l AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'import'),
p AS (SELECT src AS start, dst AS tip, [src] AS path FROM l WHERE dst > src UNION ALL
      SELECT start, l.dst, list_append(path, tip) FROM p JOIN l ON l.src = tip WHERE tip > start AND len(path) < 6 AND (l.dst = start OR (l.dst > start AND l.dst <> tip AND NOT list_contains(path, l.dst))))
SELECT array_to_string(list_append(path, tip), ',') AS path, CAST(len(path) AS INT) AS length FROM p WHERE tip = start"""


@query("cycles", WITH_GRAPH + _CYCLES)
def cycles(spark, d):
    out = graph.cycles(fx.edges(spark, d), limit=None)
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "length")


# --- metrics ---

_LINES = r"""l AS (SELECT file_path, no, regexp_replace(ls[no], '^\s+|\s+$', '', 'g') AS s FROM (SELECT file_path, string_split(content, chr(10)) AS ls FROM files), unnest(range(1, len(ls) + 1)) AS r(no)), """
_LOC = (
    _LINES
    + r"""e AS (SELECT *, CASE WHEN s = '' THEN NULL WHEN starts_with(s, '/*') THEN NOT ends_with(s, '*/') WHEN contains(s, '*/') THEN false END AS ev FROM l),
b AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM e),
c AS (SELECT *, CASE WHEN s = '' THEN 'b' WHEN inside OR starts_with(s, '/*') OR starts_with(s, '//') OR starts_with(s, '#') THEN 'c' ELSE 'k' END AS k FROM b),
loc AS (SELECT file_path, CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (WHERE k = 'k') AS INT) AS code, CAST(count(*) FILTER (WHERE k = 'c') AS INT) AS comments, CAST(count(*) FILTER (WHERE k = 'b') AS INT) AS blank FROM c GROUP BY 1)"""
)


@query("line_counts", WITH_CODE + _LOC + " SELECT file_path, total, code, comments, blank FROM loc")
def line_counts(spark, d):
    return fx.code_files(spark, d).select("file_path", metrics.line_counts(F.col("content")).alias("loc")).select("file_path", "loc.total", "loc.code", "loc.comments", "loc.blank")


_COUNT = lambda p: f"len(regexp_extract_all(content, '{p}'))"
_CC = "1 + " + " + ".join(_COUNT(p) for p in (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\b\?\s*[^:]+\s*:", "&&", r"\|\|", r"\?\?"))
_NEST = """n AS (SELECT file_path, coalesce(max(level), 0) AS max_nesting FROM (SELECT file_path, s - least(0, min(s) OVER w) AS level FROM (
  SELECT file_path, i, sum(CASE b WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY file_path ORDER BY i) AS s FROM (SELECT file_path, bs[i] AS b, i FROM (SELECT file_path, regexp_extract_all(content, '[{}]') AS bs FROM files), unnest(range(1, len(bs) + 1)) AS r(i)))
  WINDOW w AS (PARTITION BY file_path ORDER BY i)) GROUP BY 1)"""


@query("cyclomatic", WITH_PAGES + f"x AS (SELECT 1) SELECT file_path, CAST({_CC} AS INT) AS cyclomatic FROM files")
def cyclomatic(spark, d):
    return fx.page_files(spark, d).select("file_path", metrics.cyclomatic(F.col("content")).alias("cyclomatic"))


@query("max_nesting", WITH_PAGES + _NEST + " SELECT file_path, CAST(coalesce(max_nesting, 0) AS INT) AS max_nesting FROM files LEFT JOIN n USING (file_path)")
def max_nesting(spark, d):
    return fx.page_files(spark, d).select("file_path", metrics.max_nesting(F.col("content")).alias("max_nesting"))


_COGNITIVE = (
    _LINES
    + r"""o AS (SELECT *, CASE WHEN regexp_matches(s, '\b(if|for|while|switch|try)\b.*\{') THEN 1 ELSE 0 END AS op, CASE WHEN contains(s, '}') THEN 1 ELSE 0 END AS cl FROM l),
q AS (SELECT *, coalesce(sum(op - cl) OVER (PARTITION BY file_path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM o),
v AS (SELECT *, t - least(0, min(t) OVER (PARTITION BY file_path ORDER BY no)) AS lv FROM q),
g AS (SELECT file_path, sum(CASE WHEN op = 1 THEN 1 + lv WHEN regexp_matches(s, '\belse\s+if\b') THEN 1 WHEN regexp_matches(s, '\belse\b.*\{') THEN 1 WHEN regexp_matches(s, '\bcatch\b') THEN 1 + lv
  WHEN regexp_matches(s, '&&|\|\|') THEN len(regexp_extract_all(s, '&&|\|\|')) WHEN regexp_matches(s, '\b(break|continue)\s+\w+') THEN 1 ELSE 0 END) AS cognitive FROM v GROUP BY 1)"""
)


@query("cognitive", WITH_CODE + _COGNITIVE + " SELECT file_path, CAST(cognitive AS INT) AS cognitive FROM g")
def cognitive(spark, d):
    return fx.code_files(spark, d).select("file_path", metrics.cognitive(F.col("content")).alias("cognitive"))


_OPS = "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in fixed.HALSTEAD_OPERATORS) + "]"
_KEYS = ", ".join(f"'{k}'" for k in fixed.HALSTEAD_KEYWORDS)
_HALSTEAD = rf"""h AS (SELECT file_path, list_transform({_OPS}, lambda o: (length(content) - length(replace(content, o, ''))) // length(o)) AS os,
  list_filter(regexp_extract_all(content, '\b[a-zA-Z_]\w*\b'), lambda w: w NOT IN ({_KEYS})) AS ws FROM files),
k AS (SELECT file_path, len(list_filter(os, lambda x: x > 0)) AS n1, CAST(list_sum(os) AS BIGINT) AS t1, len(list_distinct(ws)) AS n2, len(ws) AS t2 FROM h),
hal AS (SELECT file_path, n1 + n2 AS vocabulary, t1 + t2 AS length, (t1 + t2) * log2(greatest(n1 + n2, 1)::DOUBLE) AS v, CASE WHEN n2 > 0 THEN (n1 / 2::DOUBLE) * (t2 / n2::DOUBLE) ELSE 0 END AS d FROM k)"""


@query("halstead", WITH_PAGES + _HALSTEAD + " SELECT file_path, CAST(vocabulary AS INT) AS vocabulary, CAST(length AS INT) AS length, floor(v * 100 + 0.5) / 100 AS volume, floor(d * 100 + 0.5) / 100 AS difficulty, floor(v / 3000 * 1000 + 0.5) / 1000 AS bugs FROM hal")
def halstead(spark, d):
    return metrics.with_halstead(fx.page_files(spark, d)).select("file_path", "vocabulary", "length", "volume", "difficulty", "bugs")


_ALL = (
    WITH_CODE
    + _LOC
    + ", "
    + _HALSTEAD
    + f""", cc AS (SELECT file_path, {_CC} AS cc FROM files), m AS (SELECT file_path, cc, code, comments, floor(greatest(0::DOUBLE, least(100::DOUBLE, (171 - 5.2::DOUBLE * ln(CASE WHEN floor(v * 100 + 0.5) / 100 > 0 THEN floor(v * 100 + 0.5) / 100 ELSE 1 END) - 0.23::DOUBLE * cc - 16.2::DOUBLE * ln(greatest(code, 1)::DOUBLE)
  + 50 * sin(sqrt(2.4::DOUBLE * CASE WHEN code > 0 THEN comments / code::DOUBLE ELSE 0 END))) * 100 / 171)) + 0.5) AS mi FROM loc JOIN hal USING (file_path) JOIN cc USING (file_path))"""
)


@query("maintainability", _ALL + " SELECT file_path, CAST(mi AS INT) AS maintainability FROM m")
def maintainability(spark, d):
    return metrics.file_metrics(fx.code_files(spark, d)).select("file_path", "maintainability")


@query("hotspots", _ALL + """, p AS (SELECT file_path, CASE WHEN cc > 10 THEN least(30::DOUBLE, log2(cc / 10::DOUBLE) * 15) ELSE 0 END + CASE WHEN code > 500 THEN least(25::DOUBLE, log2(code / 500::DOUBLE) * 10) ELSE 0 END + CASE WHEN mi < 40 THEN least(25::DOUBLE, (40 - mi) * 0.625::DOUBLE) ELSE 0 END AS s,
  concat_ws(',', CASE WHEN cc > 10 THEN 'complexity' END, CASE WHEN code > 500 THEN 'size' END, CASE WHEN mi < 40 THEN 'maintainability' END) AS reasons FROM m WHERE cc > 10 OR code > 500 OR mi < 40) SELECT file_path, floor(s + 0.5) AS score, reasons FROM p ORDER BY 2 DESC, 1 LIMIT 20""")  # fmt: skip
def hotspots(spark, d):
    return metrics.hotspots(metrics.file_metrics(fx.code_files(spark, d)))


@query("metric_issues", WITH_PAGES + _NEST + f""", c AS (SELECT file_path, {_CC} AS cc FROM files) SELECT file_path, 'complexity' AS type, CASE WHEN cc > 20 THEN 'high' ELSE 'medium' END AS severity, CAST(cc AS BIGINT) AS value FROM c WHERE cc > 10
  UNION ALL SELECT file_path, 'nesting', CASE WHEN max_nesting > 6 THEN 'high' ELSE 'medium' END, CAST(max_nesting AS BIGINT) FROM n WHERE max_nesting > 4""")  # fmt: skip
def metric_issues(spark, d):
    return metrics.issues(metrics.file_metrics(fx.page_files(spark, d))).where("type IN ('complexity', 'nesting')")


@query("metric_issues_all", _ALL + ", " + _COGNITIVE.replace(_LINES, "") + ", " + _NEST + """ SELECT file_path, 'complexity' AS type, CASE WHEN cc > 20 THEN 'high' ELSE 'medium' END AS severity, CAST(cc AS BIGINT) AS value FROM m WHERE cc > 10
  UNION ALL SELECT file_path, 'cognitive', CASE WHEN cognitive > 30 THEN 'high' ELSE 'medium' END, CAST(cognitive AS BIGINT) FROM g WHERE cognitive > 15
  UNION ALL SELECT file_path, 'nesting', CASE WHEN max_nesting > 6 THEN 'high' ELSE 'medium' END, CAST(max_nesting AS BIGINT) FROM n WHERE max_nesting > 4
  UNION ALL SELECT file_path, 'size', CASE WHEN code > 1000 THEN 'high' ELSE 'medium' END, CAST(code AS BIGINT) FROM m WHERE code > 500
  UNION ALL SELECT file_path, 'maintainability', CASE WHEN mi < 20 THEN 'high' ELSE 'medium' END, CAST(mi AS BIGINT) FROM m WHERE mi < 40""")  # fmt: skip
def metric_issues_all(spark, d):
    return metrics.issues(metrics.file_metrics(fx.code_files(spark, d)))


@query("project_summary", _ALL + """, i AS (SELECT count(*) FILTER (WHERE cc > 20) + count(*) FILTER (WHERE code > 1000) + count(*) FILTER (WHERE mi < 20) AS hi,
  count(*) FILTER (WHERE cc > 10 AND cc <= 20) + count(*) FILTER (WHERE code > 500 AND code <= 1000) + count(*) FILTER (WHERE mi >= 20 AND mi < 40) AS me, count(*) AS n, sum(code) AS loc, avg(cc) AS c, avg(mi) AS a FROM m)
SELECT n AS total_files, CAST(loc AS BIGINT) AS total_loc, floor(c * 10 + 0.5) / 10 AS avg_complexity, floor(a + 0.5) AS avg_maintainability, floor((hi * 0.5::DOUBLE + me * 0.25::DOUBLE) * 10 + 0.5) / 10 AS debt_hours,
  CASE WHEN a >= 80 AND c <= 5 THEN 'A' WHEN a >= 60 AND c <= 10 THEN 'B' WHEN a >= 40 AND c <= 15 THEN 'C' WHEN a >= 20 THEN 'D' ELSE 'F' END AS grade FROM i""")  # fmt: skip
def project_summary(spark, d):
    m = Table(metrics.file_metrics(fx.code_files(spark, d)), "metrics").df
    found = metrics.issues(m).where("type IN ('complexity', 'size', 'maintainability')")
    return metrics.project_summary(m, found).drop("avg_coupling")


@query("coupling", WITH_GRAPH + """o AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1),
c AS (SELECT file_path, coalesce(i.n, 0) AS afferent, coalesce(o.n, 0) AS efferent FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id) WHERE type = 'file'),
r AS (SELECT *, CASE WHEN afferent + efferent > 0 THEN efferent / (afferent + efferent)::DOUBLE ELSE 0.5 END AS x FROM c)
SELECT file_path, afferent, efferent, floor(x * 100 + 0.5) / 100 AS instability, floor(abs(x - 1) * 100 + 0.5) / 100 AS distance FROM r""")  # fmt: skip
def coupling(spark, d):
    return metrics.coupling(fx.edges(spark, d), fx.nodes(spark, d))


# --- security ---


def _scan_sql(table: list[tuple], keep: dict[int, str], flags) -> str:
    """Matches of all patterns with line, code before and row; patterns as RE2 takes them."""
    out = []
    for k, row in enumerate(table):
        p, ic = flags(row)
        p = p.replace("""(?!\\s*['"`])""", """[^\\s'"`]""").replace("(?![A-Za-z0-9_])", r"\b").replace("(?<![A-Za-z0-9_])", r"\b").replace("'", "''")
        p = ("(?i)" if ic else "") + p
        out.append(f"SELECT file_path, {k} AS k, ls, parts[1:i] AS before, hits[1:i - 1] AS prior, hits[i] AS text FROM (SELECT file_path, string_split(content, chr(10)) AS ls, regexp_split_to_array(content, '{p}') AS parts, regexp_extract_all(content, '{p}') AS hits FROM files WHERE regexp_matches(content, '{p}')), unnest(range(1, len(hits) + 1)) AS r(i)" + (f" WHERE {keep[k]}" if k in keep else ""))
    return f"raw AS ({' UNION ALL '.join(out)}), spot AS (SELECT file_path, k, text, ls, array_to_string(list_concat(before, prior), '') AS u, length(array_to_string(before, '')) + length(array_to_string(prior, '')) AS off, before[len(before)] AS gap FROM raw), found AS (SELECT *, CAST(1 + length(u) - length(replace(u, chr(10), '')) AS INT) AS line FROM spot)"


_TYPE = lambda t, i: "CASE k " + " ".join(f"WHEN {k} THEN '{r[i]}'" for k, r in enumerate(t)) + " END"
_VULNS = (
    WITH_CODE
    + _scan_sql(fixed.VULNERABILITIES, {5: "false", 14: "false"}, lambda r: (r[4], r[5]))
    + rf""", w AS (SELECT f.*, c.content, ls[line] AS row FROM found f JOIN files c USING (file_path)),
g AS (SELECT *, {_TYPE(fixed.VULNERABILITIES, 0)} AS type, {_TYPE(fixed.VULNERABILITIES, 1)} AS severity FROM w
  WHERE NOT regexp_matches(CASE WHEN line = 1 THEN substr(row, 1, CAST(off AS INT)) ELSE ltrim(row) END, '^\s*(//|/\*|\*)')
    AND (k <> 10 OR regexp_matches(substr(content, greatest(CAST(off AS INT) - 199, 1), least(CAST(off AS INT), 200) + 200), '(?i)(?:token|secret|password|passwd|pass_|credential|session[_-]?id|api[_-]?key|private[_-]?key|access[_-]?key|nonce|salt|otp|verification[_-]?code)\b'))
    AND k NOT IN (19, 20)),
vulns AS (SELECT file_path, line, type, min_by(severity, k * 1000000 + off) AS severity FROM g GROUP BY ALL)"""
)
_SECRETS = (
    WITH_CODE
    + _scan_sql(fixed.SECRETS, {}, lambda r: (r[2], r[3]))
    + rf""", g AS (SELECT *, {_TYPE(fixed.SECRETS, 0)} AS type, {_TYPE(fixed.SECRETS, 1)} AS confidence, length(text) AS n FROM found WHERE NOT regexp_matches(ls[line], '^\s*(//|#)') AND NOT regexp_matches(ls[line], 'example|placeholder|process\.env|getenv')),
secrets AS (SELECT file_path, line, type, min_by(confidence, k * 1000000 + off) AS confidence, min_by(CASE WHEN n <= 10 THEN repeat('*', n) ELSE substr(text, 1, 4) || repeat('*', n - 8) || substr(text, n - 3, 4) END, k * 1000000 + off) AS preview FROM g GROUP BY ALL)"""
)


@query("vulnerabilities", _VULNS + " SELECT * FROM vulns")
def vulnerabilities(spark, d):
    return security.vulnerabilities(fx.code_files(spark, d)).select("file_path", "line", "type", "severity")


@query("vulnerabilities_by_type", _VULNS + " SELECT type, count(*) AS n FROM vulns GROUP BY 1")
def vulnerabilities_by_type(spark, d):
    return security.by_type(security.vulnerabilities(fx.code_files(spark, d)))


@query("secrets", _SECRETS + " SELECT * FROM secrets")
def secrets(spark, d):
    return security.secrets(fx.code_files(spark, d))


@query("ci_gate", _VULNS + ", k AS (SELECT severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS r FROM vulns) SELECT count(*) AS n, max_by(severity, r) AS worst, coalesce(max(r) >= 3, false) AS failed FROM k")
def ci_gate(spark, d):
    return security.ci_gate(security.vulnerabilities(fx.code_files(spark, d)))


@query("security_summary")
def security_summary(spark, d):
    f = fx.code_files(spark, d)
    return security.security_summary(security.vulnerabilities(f), security.secrets(f))


_BUGS = ", ".join(f"CASE WHEN regexp_matches(s, '{('(?i)' if i else '') + p.replace(chr(39), chr(39) * 2)}') THEN '{n}|{v}' END" for n, v, p, i in fixed.BUG_PATTERNS)
_ROWS = "l AS (SELECT file_path, CAST(no AS INT) AS line, ls[no] AS s FROM (SELECT file_path, string_split(content, chr(10)) AS ls FROM files), unnest(range(1, len(ls) + 1)) AS r(no))"


@query("bug_patterns", WITH_CODE + _ROWS + f", h AS (SELECT file_path, line, unnest(list_filter([{_BUGS}], lambda x: x IS NOT NULL)) AS h FROM l) SELECT file_path, line, split_part(h, '|', 1) AS name, split_part(h, '|', 2) AS severity FROM h")
def bug_patterns(spark, d):
    return security.bug_patterns(fx.code_files(spark, d))


# --- dead code ---


@query("empty_blocks", WITH_CODE + _LINES + r"n AS (SELECT *, lead(s) OVER (PARTITION BY file_path ORDER BY no) AS nx FROM l) SELECT file_path, CAST(no AS INT) AS line, 'if' AS type FROM n WHERE nx = '}' AND regexp_matches(s, '(?:if|else)\s*(?:\([^)]*\))?\s*\{\s*$')")
def empty_blocks(spark, d):
    return dead_code.empty_blocks(fx.code_files(spark, d)).select("file_path", "line", "type")


@query("commented_code", WITH_FILES.replace("text AS content", "regexp_replace(text, '(?m)^(.)', '// if \\1', 'g') AS content") + _ROWS + r""", c AS (SELECT * FROM l WHERE regexp_matches(s, '^\s*//\s*(const|let|var|function|class|if|for|while|return|import|export)\b')),
g AS (SELECT file_path, line, line - row_number() OVER (PARTITION BY file_path ORDER BY line) AS i FROM c) SELECT file_path, min(line) AS start_line, max(line) AS end_line, count(*) AS n FROM g GROUP BY file_path, i HAVING count(*) >= 3""")  # fmt: skip
def commented_code(spark, d):
    f = fx.files(spark, d).withColumn("content", F.regexp_replace("content", "(?m)^(.)", "// if $1"))
    return dead_code.commented_code(f)


@query("unused_exports", f"WITH symbols AS ({fx.SYMBOLS_SQL}) SELECT id, name, kind, file_path, start_line FROM symbols WHERE exports AND id NOT IN (SELECT DISTINCT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity > 45) AND NOT regexp_matches(file_path, '(index|main|app)\\.(ts|js|tsx|jsx)$')")
def unused_exports(spark, d):
    edges = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return dead_code.unused_exports(fx.symbols(spark, d), edges)


@query("unused_variables")
def unused_variables(spark, d):
    return dead_code.unused_variables(fx.code_files(spark, d), None)


# --- duplication ---

_NORM = r"""nl AS (SELECT file_path, list_transform(string_split(content, chr(10)), lambda s: regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '//.*$', ''), '[''"`][^''"`]*[''"`]', '""', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS ls FROM files)"""


@query("clone_runs", WITH_FILES + _NORM + """, l AS (SELECT file_path, no AS line, ls[no] AS s FROM nl, unnest(range(1, len(ls) + 1)) AS r(no) WHERE length(ls[no]) >= 10),
f AS (SELECT s, min(file_path) AS file1, min_by(line, (file_path, line)) AS line1 FROM l GROUP BY s HAVING count(DISTINCT file_path) > 1),
p AS (SELECT file1, line1, l.file_path AS file2, l.line AS line2 FROM l JOIN f USING (s) WHERE l.file_path <> file1),
g AS (SELECT *, line2 - line1 AS d, line2 - row_number() OVER (PARTITION BY file1, file2, line2 - line1 ORDER BY line2) AS i FROM p)
SELECT file1, CAST(min(line1) AS INT) AS line1, file2, CAST(min(line2) AS INT) AS line2, count(*) AS n FROM g GROUP BY file1, file2, d, i HAVING count(*) >= 6""")  # fmt: skip
def clone_runs(spark, d):
    return duplication.clone_runs(fx.files(spark, d))


@query("clone_pair_runs", WITH_FILES + _NORM + """, l AS (SELECT file_path, no AS line, ls[no] AS s FROM nl, unnest(range(1, len(ls) + 1)) AS r(no) WHERE length(ls[no]) >= 3),
p AS (SELECT a.file_path AS file1, b.file_path AS file2, b.line AS line2, b.line - a.line AS d, length(a.s) >= 10 AS seed FROM l a JOIN l b USING (s) WHERE a.file_path < b.file_path),
g AS (SELECT *, line2 - row_number() OVER (PARTITION BY file1, file2, d ORDER BY line2) AS i FROM p),
r AS (SELECT file1, file2, d, min(line2) FILTER (WHERE seed) AS line2, max(line2) AS e FROM g GROUP BY file1, file2, d, i)
SELECT file1, CAST(line2 - d AS INT) AS line1, file2, CAST(line2 AS INT) AS line2, e - line2 + 1 AS n FROM r WHERE e - line2 >= 5""")  # fmt: skip
def clone_pair_runs(spark, d):
    return duplication.clone_pair_runs(fx.files(spark, d))


_WINDOWS = "w AS (" + " UNION ALL ".join(f"SELECT file_path, {w} AS size, i AS start_line, array_to_string(list_filter(ls[i:i + {w - 1}], lambda s: s <> ''), chr(10)) AS t FROM nl, unnest(range(1, len(ls) - {w} + 2)) AS r(i)" for w in duplication.WINDOWS) + ")"


@query("clone_window_groups", WITH_FILES + _NORM + ", " + _WINDOWS + " SELECT sha256(t) AS block, CAST(size AS INT) AS size, count(DISTINCT file_path) AS files FROM w WHERE length(t) >= 20 GROUP BY t, size HAVING count(DISTINCT file_path) > 1")
def clone_window_groups(spark, d):
    w = duplication.clone_windows(fx.files(spark, d))
    return w.groupBy("block", "size").agg(F.count_distinct("file_path").alias("files")).where("files > 1")


@query("clone_windows")
def clone_windows(spark, d):
    return duplication.clone_windows(fx.files(spark, d))


@query("top_clones")
def top_clones(spark, d):
    return duplication.top_clones(duplication.clone_windows(fx.files(spark, d))).select("block", "size", F.size("instances").alias("shown"))


@query("duplication_summary")
def duplication_summary(spark, d):
    return duplication.duplication_summary(duplication.clone_windows(fx.files(spark, d)))


# --- rules, architecture, impact ---


@query("rule_max_dependencies", WITH_GRAPH + "x AS (SELECT 1) SELECT file_path AS file, count(*) AS value FROM edges JOIN nodes ON id = src GROUP BY src, file_path HAVING count(*) > 10")
def rule_max_dependencies(spark, d):
    engine = rules.RulesEngine([r for r in rules.default_rules() if r.type == "max-dependencies"])
    return engine.check(rules.Project(nodes=fx.nodes(spark, d), edges=fx.edges(spark, d))).select("file", "value")


@query("rule_no_import", WITH_GRAPH + "x AS (SELECT 1) SELECT a.file_path AS file, b.file_path AS target, count(*) AS value FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.file_path LIKE '%/domain/%' AND b.file_path LIKE '%/utils/%' GROUP BY 1, 2")
def rule_no_import(spark, d):
    engine = rules.RulesEngine([r for r in rules.default_rules() if r.type == "no-import"])
    return engine.check(rules.Project(nodes=fx.nodes(spark, d), edges=fx.edges(spark, d))).select("file", "target", "value")


@query("rule_layer_boundary", WITH_GRAPH + """x AS (SELECT 1) SELECT a.file_path AS file, b.file_path AS target, count(*) AS value FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst
WHERE (a.file_path LIKE '%/domain/%' AND (b.file_path LIKE '%/application/%' OR b.file_path LIKE '%/infrastructure/%')) OR (a.file_path LIKE '%/application/%' AND b.file_path LIKE '%/infrastructure/%') GROUP BY 1, 2""")  # fmt: skip
def rule_layer_boundary(spark, d):
    engine = rules.RulesEngine([r for r in rules.default_rules() if r.type == "layer-boundary"])
    engine.toggle("layer-boundary-clean", True)
    return engine.check(rules.Project(nodes=fx.nodes(spark, d), edges=fx.edges(spark, d))).select("file", "target", "value")


@query("rule_max_file_size", WITH_FILES + "x AS (SELECT 1) SELECT file_path AS file, len(string_split(content, chr(10))) AS value FROM files WHERE len(string_split(content, chr(10))) > 50")
def rule_max_file_size(spark, d):
    engine = rules.RulesEngine([rules.Rule("lines", "Lines", "max-file-size", "warning", True, {"max": 50})])
    return engine.check(rules.Project(files=fx.files(spark, d))).select("file", "value")


@query("rule_max_function_length", WITH_SYMBOLS + "x AS (SELECT 1) SELECT file_path AS file, name AS target, CAST(end_line - start_line AS BIGINT) AS value FROM symbols WHERE kind = 'function' AND end_line - start_line > 46")
def rule_max_function_length(spark, d):
    engine = rules.RulesEngine([rules.Rule("long", "Long", "max-function-length", "warning", True, {"max": 46})])
    return engine.check(rules.Project(symbols=fx.symbols(spark, d))).select("file", "target", "value")


@query("rule_no_god_class", WITH_SYMBOLS + """c AS (SELECT name AS target, min(file_path) AS file FROM symbols WHERE kind = 'class' GROUP BY 1), f AS (SELECT file_path AS file, count(*) AS value FROM symbols WHERE kind = 'function' GROUP BY 1 HAVING count(*) > 3) SELECT file, target, value FROM c JOIN f USING (file)""")
def rule_no_god_class(spark, d):
    engine = rules.RulesEngine([rules.Rule("god", "God", "no-god-class", "warning", True, {"max": 3})])
    return engine.check(rules.Project(symbols=fx.symbols(spark, d))).select("file", "target", "value")


@query("rule_naming", WITH_SYMBOLS + "x AS (SELECT 1) SELECT file_path AS file, name AS target FROM symbols WHERE exports AND NOT regexp_matches(name, '^(red|blue)')")
def rule_naming(spark, d):
    engine = rules.RulesEngine([rules.Rule("n", "N", "naming-convention", "info", True, {"file": ".", "pattern": "^(red|blue)"})])
    return engine.check(rules.Project(symbols=fx.symbols(spark, d))).select("file", "target")


@query("rules_summary")
def rules_summary(spark, d):
    p = rules.Project(fx.files(spark, d), fx.symbols(spark, d), fx.nodes(spark, d), fx.edges(spark, d))
    return rules.summary(rules.RulesEngine().check(p))


@query("context_of", WITH_GRAPH + "x AS (SELECT 1) SELECT file_path, CASE WHEN file_path LIKE '%/domain/%' THEN 'domain' WHEN file_path LIKE '%/application/%' THEN 'application' WHEN file_path LIKE '%/infrastructure/%' THEN 'infrastructure' END AS context FROM nodes")
def context_of(spark, d):
    return impact.context_of(fx.nodes(spark, d), LAYERED)


@query("isolation_violations", WITH_GRAPH + """x AS (SELECT 1) SELECT DISTINCT CASE WHEN a.file_path LIKE '%/domain/%' THEN 'domain' ELSE 'application' END AS context, a.file_path AS source, b.file_path AS target FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst
WHERE (a.file_path LIKE '%/domain/%' AND (b.file_path LIKE '%/infrastructure/%' OR b.file_path LIKE '%/utils/%')) OR (a.file_path LIKE '%/application/%' AND b.file_path LIKE '%/infrastructure/%')""")  # fmt: skip
def isolation_violations(spark, d):
    return impact.isolation_violations(fx.edges(spark, d), fx.nodes(spark, d), LAYERED)


_AFFECTED = WITH_GRAPH + "r AS (SELECT 7::BIGINT AS id, 0 AS distance UNION SELECT e.src, distance + 1 FROM r JOIN edges e ON e.dst = r.id WHERE distance < 5), a AS (SELECT id, min(distance) AS distance FROM r GROUP BY id) "


def _affected(spark, d):
    nodes = fx.nodes(spark, d)
    edges = fx.edges(spark, d)
    path = nodes.where("id = 7").select("file_path").first()[0]
    return edges, impact.affected_nodes(edges, nodes, impact.changed_nodes(nodes, [path]))


@query("affected_nodes", _AFFECTED + "SELECT id, name, distance, CASE distance WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS level FROM a JOIN nodes USING (id)")
def affected_nodes(spark, d):
    return _affected(spark, d)[1].select("id", "name", "distance", "level")


@query("impact_subgraph", _AFFECTED + "SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a)")
def impact_subgraph(spark, d):
    edges, found = _affected(spark, d)
    return impact.impact_subgraph(edges, found)


# --- profile, questions, documents, libraries ---


@query("language_mix", WITH_CODE + "x AS (SELECT 1) SELECT 'javascript' AS language, count(*) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines, 100.0::DOUBLE AS share FROM files")
def language_mix(spark, d):
    return reports.language_mix(fx.code_files(spark, d))


@query("folder_mix", WITH_FILES + "x AS (SELECT 1) SELECT split_part(file_path, '/', 1) AS folder, count(*) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM files GROUP BY 1")
def folder_mix(spark, d):
    return reports.folder_mix(fx.files(spark, d))


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for p, n in fixed.INTENTS if p.isascii()) + " ELSE 'general' END"


@query("intents", f"WITH q AS (SELECT conv_id, turn, concat(CASE turn % 4 WHEN 0 THEN 'where is class ' WHEN 1 THEN 'explain ' WHEN 2 THEN 'find bugs in ' ELSE '' END, text) AS t FROM conversations) SELECT conv_id, turn, {_INTENT} AS intent FROM q")
def intents(spark, d):
    q = spark.read.parquet(f"{d}/conversations.parquet")
    head = F.when(F.col("turn") % 4 == 0, "where is class ").when(F.col("turn") % 4 == 1, "explain ").when(F.col("turn") % 4 == 2, "find bugs in ").otherwise("")
    return q.select("conv_id", "turn", reports.intent(F.concat(head, "text")).alias("intent"))


@query("relevant_files", WITH_FILES + "x AS (SELECT 1), s AS (SELECT file_path, round(CASE WHEN contains(lower(file_path), 'src1') THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN contains(lower(content), 'src1') THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN contains(lower(file_path), 'that') THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN contains(lower(content), 'that') THEN 0.3 ELSE 0 END::DOUBLE, 6) AS score FROM files) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, file_path LIMIT 10")
def relevant_files(spark, d):
    return reports.relevant_files(fx.files(spark, d), ["src1", "that"])


@query("usages", WITH_FILES + _ROWS + r" SELECT file_path, line, s AS text FROM l WHERE regexp_matches(s, '\bthing\b')")
def usages(spark, d):
    return reports.usages(fx.files(spark, d), "thing", None)


@query("detect_libraries", WITH_PAGES.replace("pages/p_", "vendor/p_") + "x AS (SELECT 1) SELECT file_path, regexp_replace(split_part(file_path, '/', 2), '\\.js$', '') AS name, 'vendor-dir' AS detected_by FROM files")
def detect_libraries(spark, d):
    f = fx.page_files(spark, d).withColumn("file_path", F.regexp_replace("file_path", "^pages/", "vendor/"))
    return library.detect_libraries(f).select("file_path", "name", "detected_by")


@query("minified_files")
def minified_files(spark, d):
    return library.detect_libraries(fx.page_files(spark, d))


@query("parse_declarations")
def parse_declarations(spark, d):
    return parse.symbols(parse.parse_declarations(fx.code_files(spark, d)))


@query("symbol_statistics", WITH_SYMBOLS + "x AS (SELECT 1) SELECT kind, count(*) AS n FROM symbols GROUP BY 1")
def symbol_statistics(spark, d):
    return parse.symbol_statistics(fx.symbols(spark, d))


@query("graphml_edges", WITH_GRAPH + "x AS (SELECT 1) SELECT concat('e', row_number() OVER (ORDER BY CAST(src AS VARCHAR), CAST(dst AS VARCHAR), type) - 1) AS id, CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS target, type FROM edges")
def graphml_edges(spark, d):
    return reports.graphml_edges(fx.edges(spark, d))


@query("graphml_nodes", WITH_GRAPH + """x AS (SELECT 1) SELECT CAST(id AS VARCHAR) AS id, concat('<node id="', id, '"><data key="d0">', split_part(file_path, '/', 3), '</data><data key="d1">', type, '</data></node>') AS xml FROM nodes""")
def graphml_nodes(spark, d):
    return reports.graphml_nodes(fx.nodes(spark, d))


@query("metrics_csv", _ALL + ", " + _COGNITIVE.replace(_LINES, "") + """ SELECT concat('"', file_path, '",', total, ',', loc.code, ',', loc.comments, ',', cc, ',', CAST(cognitive AS INT), ',', printf('%.2f', mi), ',0,0,0.50') AS line FROM loc JOIN m USING (file_path) JOIN g USING (file_path)""")
def metrics_csv(spark, d):
    return reports.metrics_csv(metrics.file_metrics(fx.code_files(spark, d)))


# --- chunks, snapshots, streams ---

_TOK = r"""list_sum(list_transform(regexp_extract_all(content, '[ \t]+|[\r\n]|[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*|[0-9][0-9.]*|(?s:.)'),
  lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z_\x{80}-\x{10FFFF}]') THEN ceil(length(r) / 4.0) WHEN regexp_matches(r, '^[0-9]') THEN ceil(length(r) / 3.0) ELSE 1 END))"""


@query("count_tokens", WITH_FILES + f"x AS (SELECT 1) SELECT file_path, CAST(coalesce({_TOK}, 0) AS INT) AS tokens FROM files")
def count_tokens(spark, d):
    return fx.files(spark, d).select("file_path", chunks.count_tokens(F.col("content")).alias("tokens"))


_TOKB = r"""list_sum(list_transform(regexp_extract_all(content, '[ \t\x0b\f]+|[\r\n]|[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*|[0-9][0-9.eExX+\-a-fA-F]*|(?:==|!=|<=|>=|&&|\|\||=>|->|::|\+\+|--|\+=|-=|\*=|/=)=?|(?s:.)'),
  lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z_\x{80}-\x{10FFFF}]') THEN ceil(octet_length(encode(r)) / 4.0) WHEN regexp_matches(r, '^[0-9]') THEN ceil(octet_length(encode(r)) / 3.0) ELSE 1 END))"""


@query("count_tokens_bytes", WITH_PAGES + f"x AS (SELECT 1) SELECT file_path, CAST(coalesce({_TOKB}, 0) AS INT) AS tokens FROM files")
def count_tokens_bytes(spark, d):
    return fx.page_files(spark, d).select("file_path", chunks.count_tokens_bytes(F.col("content")).alias("tokens"))


@query("boundary_chunks")
def boundary_chunks(spark, d):
    return chunks.boundary_chunks(fx.code_files(spark, d)).drop("content")


@query("sliding_chunks")
def sliding_chunks(spark, d):
    return chunks.sliding_chunks(fx.files(spark, d)).drop("content")


@query("logical_chunks")
def logical_chunks(spark, d):
    return chunks.logical_chunks(fx.files(spark, d).withColumn("language", parse.language_of(F.col("file_path"))))


_SNAPS = """WITH old AS (SELECT 'd/' || lang || '/' || doc_id AS path, sha256(text) AS h FROM documents WHERE n_chars < 4000),
new AS (SELECT CASE WHEN source = 'src3' THEN 'moved/' ELSE 'd/' END || lang || '/' || doc_id AS path, sha256(CASE WHEN source = 'src5' THEN text || '!' ELSE text END) AS h FROM documents WHERE n_chars > 200), """
_DIFF = (
    _SNAPS
    + """gone AS (SELECT * FROM old ANTI JOIN new USING (path)), came AS (SELECT * FROM new ANTI JOIN old USING (path)),
x AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM gone), y AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM came),
mv AS (SELECT y.path, x.path AS old_path FROM x JOIN y USING (h, k))
SELECT 'modified' AS type, path, NULL::VARCHAR AS old_path FROM old JOIN new USING (path) WHERE old.h <> new.h UNION ALL SELECT 'renamed', path, old_path FROM mv
UNION ALL SELECT 'added', path, NULL FROM came WHERE path NOT IN (SELECT path FROM mv) UNION ALL SELECT 'deleted', path, NULL FROM gone WHERE path NOT IN (SELECT old_path FROM mv)"""
)


def _snapshots(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    old = docs.where("n_chars < 4000").select(F.concat(F.lit("d/"), "lang", F.lit("/"), "doc_id").alias("file_path"), F.col("text").alias("content"))
    top = F.when(F.col("source") == "src3", "moved/").otherwise("d/")
    text = F.when(F.col("source") == "src5", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return old, docs.where("n_chars > 200").select(F.concat(top, "lang", F.lit("/"), "doc_id").alias("file_path"), text.alias("content"))


@query("snapshot_diff", _DIFF)
def snapshot_diff(spark, d):
    old, new = _snapshots(spark, d)
    return snapshot.diff(snapshot.snapshot(old), snapshot.snapshot(new))


@query("snapshot_diff_counts", _DIFF.replace("SELECT 'modified' AS type", ", r AS (SELECT 'modified' AS type", 1).replace("mv AS (SELECT y.path, x.path AS old_path FROM x JOIN y USING (h, k))\n,", "mv AS (SELECT y.path, x.path AS old_path FROM x JOIN y USING (h, k)),") + ") SELECT type, count(*) AS n FROM r GROUP BY 1")
def snapshot_diff_counts(spark, d):
    old, new = _snapshots(spark, d)
    return snapshot.diff_counts(snapshot.diff(snapshot.snapshot(old), snapshot.snapshot(new)))


@query("content_hash", WITH_FILES + "x AS (SELECT 1) SELECT file_path AS path, CASE WHEN content = '' THEN '0' ELSE CAST(CAST('0x' || substr(sha256(content), 1, 16) AS UBIGINT) AS VARCHAR) END AS content_hash, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM files")
def content_hash(spark, d):
    return snapshot.snapshot(fx.files(spark, d))


@query("folder_counts", WITH_FILES + "e AS (SELECT unnest(['', split_part(file_path, '/', 1), split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2)]) AS folder, octet_length(encode(content)) AS s FROM files) SELECT folder, count(*) AS files, CAST(sum(s) AS BIGINT) AS size FROM e GROUP BY 1")
def folder_counts(spark, d):
    return snapshot.folder_counts(snapshot.snapshot(fx.files(spark, d)))


@query("merkle", WITH_FILES + """f AS (SELECT file_path AS path, CASE WHEN content = '' THEN '0' ELSE CAST(CAST('0x' || substr(sha256(content), 1, 16) AS UBIGINT) AS VARCHAR) END AS hash FROM files),
b AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(hash, ',' ORDER BY path)) AS hash FROM f GROUP BY 1),
a AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(hash, ',' ORDER BY path)) AS hash FROM b GROUP BY 1),
r AS (SELECT '' AS path, sha256(string_agg(hash, ',' ORDER BY path)) AS hash FROM a)
SELECT * FROM f UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a UNION ALL SELECT * FROM r""")  # fmt: skip
def merkle(spark, d):
    return snapshot.merkle(snapshot.snapshot(fx.files(spark, d)))


@query("merkle_combined")
def merkle_combined(spark, d):
    return snapshot.merkle_combined(snapshot.snapshot(fx.files(spark, d)))


_EVENTS = "e AS (SELECT concat('src/f', user_id, '.ts') AS path, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'change' END AS type, ts FROM events)"
_SESSIONS = "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS k FROM g), c AS (SELECT path, max_by(type, ts) AS type, max(ts) AS ts, count(*) AS n FROM s GROUP BY path, k)"


def events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("change")
    return e.select(F.concat(F.lit("src/f"), "user_id", F.lit(".ts")).alias("path"), kind.alias("type"), F.col("ts").cast("timestamp").alias("ts"))


@query("debounced_changes", f"WITH {_EVENTS}, {_SESSIONS} SELECT path, type, epoch_us(ts) AS us, n FROM c")
def debounced_changes(spark, d):
    return watch.debounce(watch.watched_events(events(spark, d)), "1 hour").select("path", "type", F.unix_micros("ts").alias("us"), "n")


@query("reindex_batches", f"WITH {_EVENTS}, {_SESSIONS}, bg AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 1 MINUTE OR lag(ts) OVER (ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM c), bs AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM bg) SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS changes FROM bs GROUP BY k")
def reindex_batches(spark, d):
    out = watch.reindex_batches(watch.debounce(events(spark, d), "1 hour"), "1 minute")
    return out.select(F.unix_micros("first_ts").alias("first_us"), F.unix_micros("ts").alias("last_us"), "changes")


@query("watch_counters", f"WITH {_EVENTS} SELECT count(*) AS total, count(*) FILTER (WHERE type = 'add') AS added, count(*) FILTER (WHERE type = 'change') AS changed, count(*) FILTER (WHERE type = 'delete') AS deleted FROM e")
def watch_counters(spark, d):
    return watch.counters(events(spark, d)).drop("last_change")


@query("watched_files")
def watched_files(spark, d):
    return watch.watched_files(events(spark, d))


@query("glob_match", f"WITH files AS ({fx.FILES_SQL}) SELECT file_path, regexp_matches(file_path, '^fr/.*/doc_[^/]*1\\.txt$') AS hit FROM files")
def glob_match(spark, d):
    return fx.files(spark, d).select("file_path", src.any_glob(F.col("file_path"), ["fr/**/doc_*1.txt"]).alias("hit"))


