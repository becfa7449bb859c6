"""Queries over sources that are put together from the fixture tables, so that every operator has something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstack.operators import dead_code, graph, impact, metrics, parse, relations, reports, rules, search, security
from loomstack.plans.fixture_queries import QUESTION, WITH_GRAPH, WITH_PAGES, WITH_SYMBOLS, _bm25
from loomstack.plans.registry import query
from loomstack.sources import files as src
from loomstack.sources import fixtures as fx


def _made(spark, d, sql: str, *tables: str):
    """The rows of a text that both SQL dialects take; tables are views of the session, as the texts have braces of their own."""
    for t in tables:
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"made_{t}")
        sql = sql.replace(f"FROM {t}", f"FROM made_{t}")
    return spark.sql(sql)


# --- impact over all edges, with many changed nodes and paths under /core/ ---

_NODES = "n AS (SELECT id, type, name, replace(file_path, '/domain/', '/core/') AS file_path FROM nodes)"
_MANY = WITH_GRAPH + _NODES + """, r AS (SELECT id, 0 AS distance FROM nodes WHERE id % 10 = 7 UNION SELECT e.src, distance + 1 FROM r JOIN edges e ON e.dst = r.id WHERE distance < 5),
f AS (SELECT id, n.name, n.file_path, min(distance) AS distance FROM r LEFT JOIN n USING (id) GROUP BY ALL),
k AS (SELECT count(*) FILTER (WHERE distance = 0) AS critical, count(*) FILTER (WHERE distance = 1) AS high, count(*) FILTER (WHERE file_path LIKE '%/core/%') AS core, count(*) AS n, count(*) FILTER (WHERE contains(file_path, 'test')) AS tests FROM f),
c AS (SELECT unnest(['modify', 'delete', 'refactor']) AS change),
q AS (SELECT change, 1 AS o, 'wide-impact' AS kind, 'high' AS severity, 'breaking_change' AS category, 'Change affects ' || critical || ' critical components' AS description, critical AS n FROM c, k WHERE critical > 10
  UNION ALL SELECT change, 2, 'deletion-risk', 'critical', 'breaking_change', 'Deletion may break dependent components', n FROM c, k WHERE change = 'delete'
  UNION ALL SELECT change, 3, 'api-change', 'high', 'compatibility', 'Modification may break API contracts', high FROM c, k WHERE change = 'modify' AND high > 0
  UNION ALL SELECT change, 4, 'core-system-risk', 'critical', 'breaking_change', 'Change affects core system components', core FROM c, k WHERE core > 0)"""


def _many(spark, d):
    nodes = fx.nodes(spark, d).withColumn("file_path", F.replace("file_path", F.lit("/domain/"), F.lit("/core/")))
    return impact.affected_nodes(fx.edges(spark, d), nodes, nodes.where("id % 10 = 7").select("id"))


def _by_change(f):
    out = None
    for change in ("modify", "delete", "refactor"):
        one = f(change).withColumn("change", F.lit(change))
        out = one if out is None else out.unionByName(one)
    return out


@query("impact_risks", _MANY + " SELECT change, kind, severity, category, description, n FROM q")
def impact_risks(spark, d):
    found = _many(spark, d)
    return _by_change(lambda c: impact.risks(found, c)).drop("mitigation")


@query("impact_recommendations", _MANY + """ SELECT change, 'review' AS action, 'critical' AS priority, n || ' components will be affected by this change' AS details FROM c, k
  UNION ALL SELECT change, 'test', 'critical', 'Focus on: ' || (SELECT string_agg(name, ', ' ORDER BY id) FROM (SELECT id, name FROM f WHERE distance = 0 ORDER BY id LIMIT 5)) FROM c, k WHERE critical > 0
  UNION ALL SELECT change, 'check', 'critical', string_agg(description, '; ' ORDER BY o) FROM q WHERE severity IN ('critical', 'high') GROUP BY change
  UNION ALL SELECT change, 'test', 'high', 'Test files detected in affected nodes' FROM c, k WHERE tests > 0
  UNION ALL SELECT change, 'refactor', 'medium', 'Break into smaller, safer changes' FROM c WHERE change = 'refactor'""")  # fmt: skip
def impact_recommendations(spark, d):
    found = _many(spark, d)
    return _by_change(lambda c: impact.recommendations(found, impact.risks(found, c), c)).drop("description")


@query("cycle_closing_edges")
def cycle_closing_edges(spark, d):
    return rules.back_edges(fx.edges(spark, d))


# --- layers, layouts, problems ---

_LAYOUT = "l AS (SELECT id, type, replace(replace(replace(file_path, '/application/', '/application/pages/'), '/infrastructure/', '/infrastructure/components/api/'), '/utils/', '/repositories/store/Config/') AS file_path FROM nodes)"


def _layout(spark, d):
    path = F.col("file_path")
    for a, b in (("/application/", "/application/pages/"), ("/infrastructure/", "/infrastructure/components/api/"), ("/utils/", "/repositories/store/Config/")):
        path = F.replace(path, F.lit(a), F.lit(b))
    return fx.nodes(spark, d).withColumn("file_path", path)


@query("layer_coverage", WITH_GRAPH + _LAYOUT + ", h AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS layer, '{role}' AS role FROM l WHERE regexp_matches(lower(file_path), '{'|'.join(parts)}')" for name, parts, role in (
        ("Presentation", ["controller", "view", "component", "page"], "UI and API endpoints"), ("Application", ["service", "usecase", "handler"], "Business logic orchestration"),
        ("Domain", ["model", "entity", "domain", "core"], "Business rules and entities"), ("Infrastructure", ["repository", "database", "api", "external"], "External integrations"))
) + ") SELECT layer, role, count(*) AS files, CAST(floor(count(*) * 100 / (SELECT count(*) FROM l)::DOUBLE + 0.5) AS BIGINT) AS percent FROM h GROUP BY ALL")
def layer_coverage(spark, d):
    return reports.layer_coverage(_layout(spark, d))


@query("architecture_pattern", WITH_GRAPH + _LAYOUT + r""", b AS (SELECT bool_or(contains(d, 'controller')) AS c, bool_or(regexp_matches(d, '[mM]odel|entities')) AS m, bool_or(regexp_matches(d, '[vV]iew|templates')) AS v, bool_or(regexp_matches(d, 'domain|entities')) AS dom,
  bool_or(regexp_matches(d, 'usecase|use-case|application')) AS us, bool_or(contains(d, 'infra')) AS inf, bool_or(contains(d, 'repositor')) AS rep, bool_or(regexp_matches(d, '[sS]ervice')) AS sv, bool_or(regexp_matches(d, '/components\b')) AS com, bool_or(regexp_matches(d, '/views\b')) AS vv,
  bool_or(regexp_matches(d, '/(store|stores)\b')) AS st, bool_or(regexp_matches(d, '/router\b')) AS ro, bool_or(regexp_matches(d, '/composables\b')) AS cps, bool_or(regexp_matches(d, '/pages\b')) AS pg, bool_or(regexp_matches(d, '/layouts\b')) AS lay FROM (SELECT regexp_replace(file_path, '/[^/]*$', '') AS d FROM l))
SELECT 'MVC' AS pattern, CASE WHEN v THEN 90 ELSE 70 END AS confidence FROM b WHERE c AND m UNION ALL SELECT 'Clean Architecture', CASE WHEN us AND inf THEN 85 ELSE 60 END FROM b WHERE dom AND (us OR inf) UNION ALL SELECT 'Repository Pattern', 80 FROM b WHERE rep
UNION ALL SELECT 'Service Layer', 85 FROM b WHERE sv UNION ALL SELECT 'Vue SPA', CASE WHEN ro THEN 85 ELSE 75 END FROM b WHERE com AND (vv OR pg) AND st UNION ALL SELECT 'Composition API Pattern', 90 FROM b WHERE cps UNION ALL SELECT 'File-based Routing', 80 FROM b WHERE pg AND lay""")  # fmt: skip
def architecture_pattern(spark, d):
    return reports.architecture_pattern(_layout(spark, d))


_FLAT = "SELECT concat(lang, '/doc_', doc_id, '.txt') AS file_path, text AS content FROM documents"


@query("project_problems", f"WITH n AS (SELECT file_path, len(string_split(content, chr(10))) AS v FROM ({_FLAT})), " + """t AS (SELECT 'God Object' AS title, 'critical' AS severity, file_path AS subject, v AS value FROM n WHERE v > 60 UNION ALL SELECT 'Large File', 'warning', file_path, v FROM n WHERE v > 20 AND v <= 60
  UNION ALL SELECT 'High Complexity', 'warning', concat('src/', replace(p_brand, '#', ''), '/', p_type, '.ts'), count(*) FROM part GROUP BY 3 HAVING count(*) > 10
  UNION ALL SELECT 'Flat Structure', 'info', split_part(file_path, '/', 1), count(*) FROM n GROUP BY 3 HAVING count(*) > 20) SELECT * FROM t""")  # fmt: skip
def project_problems(spark, d):
    return reports.problems(_made(spark, d, _FLAT, "documents"), fx.symbols(spark, d), None, 60, 20, 10, 20, None)


@query("project_problems_with_cycles")
def project_problems_with_cycles(spark, d):
    return reports.problems(fx.files(spark, d), fx.symbols(spark, d), fx.edges(spark, d))


# --- questions ---

_TERMS = ["Red_widget", "bolt", "small-gizmo-x"]
_FUZZY = "CASE " + " ".join(
    f"WHEN s = '{t}' THEN 1 WHEN contains(s, '{t}') THEN 0.9 WHEN len(list_filter([{', '.join(repr(q) for q in t.replace('_', '-').split('-'))}], lambda q: contains(s, q))) > 0 THEN 0.5 + 0.3::DOUBLE * len(list_filter([{', '.join(repr(q) for q in t.replace('_', '-').split('-'))}], lambda q: contains(s, q))) / {len(t.replace('_', '-').split('-'))}"
    for t in (x.lower() for x in _TERMS)
) + " END"


@query("fuzzy_symbols", WITH_SYMBOLS + f"x AS (SELECT id, name, lower(name) AS s FROM symbols), y AS (SELECT id, name, round({_FUZZY}::DOUBLE, 6) AS confidence FROM x) SELECT * FROM y WHERE confidence > 0.3")
def fuzzy_symbols(spark, d):
    return reports.fuzzy_symbols(fx.symbols(spark, d), _TERMS, None)


@query("top_fuzzy_symbols", WITH_SYMBOLS + f"x AS (SELECT id, name, lower(name) AS s FROM symbols), y AS (SELECT id, name, round({_FUZZY}::DOUBLE, 6) AS confidence FROM x) SELECT * FROM y WHERE confidence > 0.3 ORDER BY confidence DESC, name, id LIMIT 10")
def top_fuzzy_symbols(spark, d):
    return reports.fuzzy_symbols(fx.symbols(spark, d), _TERMS)


@query("architecture_files", WITH_GRAPH + _LAYOUT + r" SELECT file_path FROM l WHERE regexp_matches(file_path, 'index\.(ts|js|php)$|main\.(ts|js|php)$|app\.(ts|js|vue|php)$|(?i:router|routes|controller|service|model|config)')")
def architecture_files(spark, d):
    return reports.architecture_files(_layout(spark, d), None)


@query("files_named", WITH_GRAPH + "x AS (SELECT 1) SELECT file_path, CASE WHEN contains(lower(file_path), 'domain/f_1') THEN 0.5 WHEN lower(file_path) = 'src/utils/f_3.ts' THEN 1 ELSE 0.5 END::DOUBLE AS relevance FROM nodes WHERE contains(lower(file_path), 'domain/f_1') OR contains(lower(file_path), 'src/utils/f_3.ts') ORDER BY relevance DESC, file_path LIMIT 10")
def files_named(spark, d):
    return reports.files_named(fx.nodes(spark, d), ["Domain/f_1", "src/utils/f_3.ts"])


_PATHS = "p AS (SELECT a.file_path AS src, b.file_path AS dst, e.type FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst)"


def _paths(spark, d):
    n = fx.nodes(spark, d).select("id", "file_path")
    e = fx.edges(spark, d).withColumnRenamed("src", "a").withColumnRenamed("dst", "b")
    return e.join(n.select(F.col("id").alias("a"), F.col("file_path").alias("src")), "a").join(n.select(F.col("id").alias("b"), F.col("file_path").alias("dst")), "b").select("src", "dst", "type")


@query("main_dependencies", WITH_GRAPH + _PATHS + ", c AS (SELECT src, count(*) AS n FROM p GROUP BY 1), o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, type) AS r FROM p JOIN c USING (src) WHERE n > 5 OR regexp_matches(lower(src), 'index|main|app|server')) SELECT src, dst FROM o WHERE r <= 5")
def main_dependencies(spark, d):
    return reports.main_dependencies(_paths(spark, d), 5, None)


@query("callers", WITH_GRAPH + _PATHS + " SELECT DISTINCT src FROM p WHERE dst = 'src/domain/f_4.ts' OR contains(dst, 'f_10')")
def callers(spark, d):
    return reports.callers(_paths(spark, d), "src/domain/f_4.ts", "f_10", None)


@query("file_dependencies", WITH_GRAPH + _PATHS + " SELECT src, dst FROM p WHERE src IN (SELECT file_path FROM nodes WHERE id % 9 = 2)")
def file_dependencies(spark, d):
    return reports.file_dependencies(_paths(spark, d), fx.nodes(spark, d).where("id % 9 = 2"), None)


@query("call_chain", WITH_GRAPH + "r AS (SELECT 7::BIGINT AS id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN edges e ON e.src = r.id WHERE e.type = 'import' AND depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0")
def call_chain(spark, d):
    return relations.call_chain(fx.edges(spark, d).withColumn("type", F.when(F.col("type") == "import", "call").otherwise(F.col("type"))), 7)


@query("predicted_impact", WITH_GRAPH + """r AS (SELECT id, 0 AS depth FROM nodes WHERE regexp_matches(name, '7$') UNION SELECT e.src, depth + 1 FROM r JOIN edges e ON e.dst = r.id WHERE depth < 3), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
SELECT id AS file, CAST(depth + 1 AS INT) AS level, CASE depth WHEN 0 THEN 'contains' ELSE 'depends' END AS reasons FROM m""")  # fmt: skip
def predicted_impact(spark, d):
    files = fx.nodes(spark, d).select(F.col("id").alias("file_path"), F.when(F.col("name").rlike(r"7\z"), "a seven b").otherwise("aseven").alias("content"))
    return relations.predicted_impact(files, fx.edges(spark, d), "seven", most=None)


# --- sources put together from documents ---

_ROUTES = """SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'src/routes/' ELSE 'src/other/' END, doc_id, '.ts') AS file_path,
  concat(CASE doc_id % 5 WHEN 0 THEN concat('router.get( "/a/', doc_id, '", h); x.Delete(`/c`)') WHEN 1 THEN 'app.post("/b", h)' WHEN 2 THEN '@Get() one() {} @Put("/p/:id") two()' WHEN 3 THEN '@Patch(/raw)' ELSE 'no route here' END, chr(10), text) AS content FROM documents"""
_ONE = r"""(?i)\.(get|post|put|patch|delete)\s*\(\s*[\x27"`]([^\x27"`]+)[\x27"`]"""
_TWO = "(?i)router" + _ONE[4:]
_THREE = r"""(?i)@(Get|Post|Put|Patch|Delete)\s*\(\s*[\x27"`]?([^\x27"`)]*?)[\x27"`]?\s*\)"""


@query("api_endpoints", f"WITH f AS (SELECT * FROM ({_ROUTES}) WHERE regexp_matches(file_path, 'route|controller|api')), " + "h AS (" + " UNION ALL ".join(f"SELECT file_path, unnest(list_zip(regexp_extract_all(content, '{p}', 1), regexp_extract_all(content, '{p}', 2))) AS e FROM f" for p in (_ONE, _TWO, _THREE)) + ") SELECT file_path, upper(e[1]) AS method, CASE WHEN e[2] = '' THEN '/' ELSE e[2] END AS route FROM h")
def api_endpoints(spark, d):
    return reports.api_endpoints(_made(spark, d, _ROUTES, "documents"), None)


_SLOW = """SELECT concat('src/', doc_id, '.ts') AS file_path, concat(CASE doc_id % 4 WHEN 0 THEN 'const x = readFileSync(p);' WHEN 1 THEN 'for (const a of b) { s += a; }' WHEN 2 THEN 'db.findOne({ id: 1 });' ELSE 'plain' END, chr(10), replace(text, '{', '(')) AS content FROM documents"""


@query("performance_hints", f"WITH h AS (SELECT file_path, split_part(content, chr(10), 1) AS s FROM ({_SLOW})) SELECT file_path, 1 AS line, CASE WHEN contains(s, 'readFileSync') THEN 'sync-file-read' WHEN contains(s, '+=') THEN 'string-concat-loop' ELSE 'no-index-hint' END AS name, CASE WHEN contains(s, 'readFileSync') THEN 'warning' ELSE 'info' END AS severity FROM h WHERE s <> 'plain'")
def performance_hints(spark, d):
    return security.performance_hints(_made(spark, d, _SLOW, "documents"), None)


_DEAD = """SELECT concat('src/', doc_id, '.js') AS file_path, concat(CASE doc_id % 3 WHEN 0 THEN concat('function f() {', chr(10), '  return 1;', chr(10), '  g();', chr(10), '  h();', chr(10), '}') WHEN 1 THEN concat('function f() {', chr(10), '  return 1;', chr(10), '}') ELSE 'f();' END, chr(10)) AS content FROM documents"""


@query("unreachable_code", f"WITH f AS ({_DEAD}) SELECT file_path, 3 AS start_line, 4 AS end_line, 'after-jump' AS reason FROM f WHERE contains(content, 'g()')")
def unreachable_code(spark, d):
    return dead_code.unreachable_code(_made(spark, d, _DEAD, "documents"))


_TYPES = [("ts", "typescript"), ("py", "python"), ("rs", "rust"), ("go", "go"), ("java", "java"), ("md", "markdown"), ("zzz", "unknown")]
_NAMED = "SELECT CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN concat('a/f', doc_id, '.{e}')" for i, (e, _) in enumerate(_TYPES)) + " ELSE concat('d', doc_id, '/Dockerfile') END AS file_path, text AS content FROM documents"


@query("language_of", f"WITH f AS ({_NAMED}) SELECT file_path, CASE regexp_extract(file_path, '\\.(\\w+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in _TYPES) + " ELSE 'dockerfile' END AS language FROM f")
def language_of(spark, d):
    return _made(spark, d, _NAMED, "documents").select("file_path", parse.language_of(F.col("file_path")).alias("language"))


_RELATED = """SELECT concat('src/', doc_id, '.ts') AS file_path, concat(CASE doc_id % 4 WHEN 0 THEN concat('import m', doc_id, ' from "./m"') WHEN 1 THEN 'const r = require("dep")' WHEN 2 THEN 'export class A extends B {' ELSE 'call(1)' END, chr(10)) AS content FROM documents"""


@query("relationships", f"WITH f AS ({_RELATED}), " + """n AS (SELECT file_path, content, CAST(regexp_extract(file_path, '([0-9]+)', 1) AS BIGINT) AS k FROM f) SELECT file_path, 'imports' AS kind, 'm' || k AS subject, './m' AS object FROM n WHERE k % 4 = 0 UNION ALL SELECT file_path, 'imports', 'r', 'dep' FROM n WHERE k % 4 = 1
  UNION ALL SELECT file_path, 'calls', NULL, 'require' FROM n WHERE k % 4 = 1 UNION ALL SELECT file_path, 'exports', NULL, 'A' FROM n WHERE k % 4 = 2 UNION ALL SELECT file_path, 'extends', 'A', 'B' FROM n WHERE k % 4 = 2 UNION ALL SELECT file_path, 'calls', NULL, 'call' FROM n WHERE k % 4 = 3""")  # fmt: skip
def relationships(spark, d):
    return relations.relationships(_made(spark, d, _RELATED, "documents"), None)


_VUE = """SELECT concat('src/C', doc_id, '.vue') AS file_path, concat('<template><div><C', doc_id + 1, ' /><q-btn/></div></template><script>import x from "./C', doc_id + 2, '.vue"</script>') AS content FROM documents"""


@query("template_edges", f"WITH f AS ({_VUE}) SELECT a.file_path AS src, b.file_path AS dst, 'uses' AS type FROM f a JOIN f b ON contains(a.content, '<' || regexp_extract(b.file_path, '(C[0-9]+)', 1) || ' ')")
def template_edges(spark, d):
    return relations.template_edges(_made(spark, d, _VUE, "documents")).drop("weight")


@query("vue_script_edges", f"WITH f AS ({_VUE}) SELECT a.file_path AS src, b.file_path AS dst, 'import' AS type FROM f a JOIN f b ON contains(a.content, '/' || split_part(b.file_path, '/', 2) || '\"') WHERE CAST(regexp_extract(a.file_path, '([0-9]+)', 1) AS BIGINT) % 2 = 1")
def vue_script_edges(spark, d):
    files = _made(spark, d, _VUE, "documents")
    scripts = files.select("file_path", parse.vue_script(F.col("content")).alias("content"))
    found = graph.import_edges(parse.imports(scripts), files)
    even = found.where(F.regexp_extract("src", "([0-9]+)", 1).cast("long") % 2 == 0)
    return graph.new_edges(found.union(found), even).drop("weight")


@query("symbol_import_edges", WITH_SYMBOLS + "i AS (SELECT DISTINCT file_path, 'MEDIUM' AS source FROM symbols WHERE CAST(id AS BIGINT) % 40 = 1) SELECT a.id AS src, b.id AS dst FROM i JOIN symbols a USING (file_path) JOIN symbols b ON contains(b.file_path, source)")
def symbol_import_edges(spark, d):
    syms = fx.symbols(spark, d)
    imports = syms.where("cast(id as bigint) % 40 = 1").select("file_path", F.lit("MEDIUM").alias("source"))
    return graph.symbol_import_edges(imports, syms).select("src", "dst")


@query("tree_complexity", WITH_SYMBOLS + "t AS (SELECT file_path, CASE kind WHEN 'function' THEN 'if_statement' WHEN 'class' THEN 'catch_clause' ELSE 'other' END AS type FROM symbols) SELECT file_path, CAST(1 + count(*) + count(*) FILTER (WHERE type <> 'other') AS INT) AS complexity FROM t GROUP BY 1")
def tree_complexity(spark, d):
    kind = F.when(F.col("kind") == "function", "if_statement").when(F.col("kind") == "class", "catch_clause").otherwise("other")
    return graph.tree_complexity(fx.symbols(spark, d).select("file_path", kind.alias("type")))


@query("function_complexity", WITH_SYMBOLS + "m AS (SELECT DISTINCT file_path, CAST(length(file_path) AS INT) AS cyclomatic FROM symbols), c AS (SELECT file_path, count(*) AS n FROM symbols WHERE kind = 'function' GROUP BY 1) SELECT file_path, cyclomatic, cyclomatic / coalesce(n, 1)::DOUBLE AS avg_function_complexity FROM m LEFT JOIN c USING (file_path)")
def function_complexity(spark, d):
    syms = fx.symbols(spark, d)
    return metrics.function_complexity(syms.select("file_path", F.length("file_path").alias("cyclomatic")).distinct(), syms)


_PACKAGES = """SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN NULL ELSE concat('{"dependencies": {', CASE doc_id % 3 WHEN 0 THEN '"react": "1", "vue": "3"' WHEN 1 THEN '"pg": "8", "koa": "2"' ELSE '"zzz": "1"' END, '}, "devDependencies": {"', CASE doc_id % 2 WHEN 0 THEN 'vite' ELSE 'other' END, '": "5"}}') END AS content FROM documents"""


@query("project_stack", f"WITH p AS ({_PACKAGES}) SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'Unknown stack (package.json not found)' ELSE coalesce(nullif(concat_ws(', ', CASE doc_id % 3 WHEN 0 THEN 'Frontend: Vue.js' WHEN 1 THEN 'Backend: Koa, Database: PostgreSQL' END, CASE doc_id % 2 WHEN 0 THEN 'Build: Vite' END), ''), 'Minimal project (no major frameworks)') END AS description FROM p")
def project_stack(spark, d):
    return src.project_stack(_made(spark, d, _PACKAGES, "documents")).select("doc_id", "description")


@query("stored_index_search", WITH_PAGES + _bm25("files", "file_path", "content", 20) + " SELECT id AS doc_id, score FROM s")
def stored_index_search(spark, d):
    """An index of half the pages with stale texts, brought up to date."""
    pages = fx.page_files(spark, d)
    stale = pages.where("length(file_path) % 2 = 0").withColumn("content", F.concat(F.lit("the store "), "content"))
    index = search.SearchIndex(stale)
    index.update(pages)
    return index.search(QUESTION)
