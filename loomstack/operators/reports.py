"""Project profile, question context, hints and exports."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.functions.fixed import ENTITY_STOP_WORDS, INTENTS, SYNONYMS
from loomstack.functions.storage import Table
from loomstack.functions.text import literal_map
from loomstack.operators.parse import language_of
from loomstack.operators.rules import back_edges

#: Technology by dependency names: group, name, dependencies (fixed values).
STACK = [
    ("frontend", "Vue.js", "vue @vue/cli-service"), ("frontend", "React", "react react-dom"), ("frontend", "Angular", "@angular/core"), ("frontend", "Svelte", "svelte"),
    ("frontend", "Next.js", "next"), ("frontend", "Nuxt.js", "nuxt nuxt3"), ("frontend", "Quasar", "quasar @quasar/extras @quasar/app-vite @quasar/app-webpack"),
    ("frontend", "Pinia", "pinia"), ("frontend", "Vuex", "vuex"), ("frontend", "Vue Router", "vue-router"), ("frontend", "Vuetify", "vuetify"),
    ("frontend", "Element UI", "element-plus element-ui"), ("frontend", "Tailwind CSS", "tailwindcss"), ("infrastructure", "Vite", "vite"), ("infrastructure", "Webpack", "webpack webpack-cli"),
    ("backend", "Express.js", "express"), ("backend", "Fastify", "fastify"), ("backend", "NestJS", "@nestjs/core"), ("backend", "Koa", "koa"), ("backend", "Django", "django"),
    ("backend", "Flask", "flask"), ("backend", "FastAPI", "fastapi"), ("database", "PostgreSQL", "pg postgres"), ("database", "MySQL", "mysql mysql2"), ("database", "MongoDB", "mongodb mongoose"),
    ("database", "Redis", "redis ioredis"), ("database", "Prisma", "prisma @prisma/client"), ("database", "TypeORM", "typeorm"), ("database", "SQLite", "sqlite3 better-sqlite3"),
]
#: Layers by parts of a path in lower case, and their roles (fixed values).
LAYERS = [
    ("Presentation", ["controller", "view", "component", "page"], "UI and API endpoints"),
    ("Application", ["service", "usecase", "handler"], "Business logic orchestration"),
    ("Domain", ["model", "entity", "domain", "core"], "Business rules and entities"),
    ("Infrastructure", ["repository", "database", "api", "external"], "External integrations"),
]
#: Paths of files that show the architecture (fixed values).
ARCHITECTURE_FILES = [r"index\.(ts|js|php)\z", r"main\.(ts|js|php)\z", r"app\.(ts|js|vue|php)\z", "(?i)router", "(?i)routes", "(?i)controller", "(?i)service", "(?i)model", "(?i)config"]
ENTRY_POINTS = ["index", "main", "app", "server"]


def language_mix(files: DataFrame) -> DataFrame:
    """(language, files, lines, share) with the share of files in percent."""
    n = files.select(language_of(F.col("file_path")).alias("language"), F.size(F.split("content", "\n", -1)).alias("n"))
    by = n.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"))
    total = n.agg(F.count(F.lit(1)).alias("t"))
    return by.crossJoin(total).select("language", "files", "lines", (F.floor(F.col("files") * 1000 / F.col("t") + 0.5) / 10).alias("share"))


def folder_mix(files: DataFrame) -> DataFrame:
    """(folder, files, lines) of top-level folders."""
    top = F.when(F.col("file_path").contains("/"), F.substring_index("file_path", "/", 1)).otherwise("")
    return files.select(top.alias("folder"), F.size(F.split("content", "\n", -1)).alias("n")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"))


def large_files(files: DataFrame, over: int = 500, limit: int = 10) -> DataFrame:
    n = F.size(F.split("content", "\n", -1))
    return files.select("file_path", n.alias("lines")).where(F.col("lines") > over).orderBy(F.desc("lines"), "file_path").limit(limit)


def tech_stack(dependencies: DataFrame) -> DataFrame:
    """(kind, name) of technologies that a dependency (name) stands for."""
    rules = dependencies.sparkSession.createDataFrame([(g, n, d) for g, n, ds in STACK for d in ds.split()], "kind string, tech string, dep string")
    return rules.join(dependencies.select(F.col("name").alias("dep")).distinct(), "dep", "left_semi").select("kind", F.col("tech").alias("name")).distinct()


def layer_coverage(files: DataFrame) -> DataFrame:
    """(layer, role, files, percent) of the layers that have files; a file counts in each layer of which its path has a part."""
    low = F.lower("file_path")
    has = lambda parts: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])
    mine = F.filter(F.array(*[F.when(has(parts), F.struct(F.lit(name).alias("layer"), F.lit(role).alias("role"))) for name, parts, role in LAYERS]), lambda x: x.isNotNull())
    by = files.select(F.explode(mine).alias("l")).groupBy("l.layer", "l.role").agg(F.count(F.lit(1)).alias("files"))
    return by.crossJoin(files.agg(F.count(F.lit(1)).alias("t"))).select("layer", "role", "files", F.floor(F.col("files") * 100 / F.col("t") + 0.5).cast("long").alias("percent"))


def folder_of(path: Column) -> Column:
    """The path without its last part; "/" for files at the top."""
    folder = F.regexp_replace(F.regexp_replace(path, r"\\\\", "/"), r"/?[^/]*\z", "")
    return F.when(folder == "", "/").otherwise(folder)


#: Titles and severities of problems (fixed values).
SEVERITIES = {"critical": 0, "warning": 1, "info": 2}


def problems(files: DataFrame, symbols: DataFrame, edges: DataFrame | None = None, god: int = 1000, large: int = 500, crowd: int = 50, flat_most: int = 20, most: int | None = 10) -> DataFrame:
    """(title, severity, subject, value) by severity: god objects and large files (the ``most`` largest), crowded files, cycles, flat folders at the top."""
    n = F.size(F.split("content", "\n", -1)).cast("long")
    sized = files.select(F.col("file_path").alias("subject"), n.alias("value")).where(F.col("value") > large)
    if most is not None:
        sized = sized.orderBy(F.desc("value"), "subject").limit(most)
    row = lambda df, title, severity: df.select(F.lit(title).alias("title"), F.lit(severity).alias("severity"), "subject", "value")
    crowded = symbols.groupBy(F.col("file_path").alias("subject")).agg(F.count(F.lit(1)).alias("value")).where(F.col("value") > crowd)
    folder = folder_of(F.col("file_path"))
    flat = files.groupBy(folder.alias("subject")).agg(F.count(F.lit(1)).alias("value")).where((F.col("value") > flat_most) & ~F.contains("subject", F.lit("/")))
    found = [row(sized.where(F.col("value") > god), "God Object", "critical"), row(sized.where(F.col("value") <= god), "Large File", "warning"), row(crowded, "High Complexity", "warning"), row(flat, "Flat Structure", "info")]
    if edges is not None:
        cycles = back_edges(edges).agg(F.count(F.lit(1)).alias("value")).where("value > 0").select(F.lit(None).cast("string").alias("subject"), "value")
        found.append(row(cycles, "Circular Dependencies", "critical"))
    return reduce(DataFrame.unionByName, found).orderBy(literal_map(SEVERITIES)[F.col("severity")], "title", "subject")


def architecture_pattern(files: DataFrame) -> DataFrame:
    """(pattern, confidence) of layouts that folder names point to, the most certain first, then in the order of the list."""
    d = folder_of(F.col("file_path"))
    has = lambda p: F.coalesce(F.bool_or(d.rlike(p)), F.lit(False))
    named = lambda p: has(rf"(?i)/({p})(?![A-Za-z0-9_])")
    a = files.agg(
        has("[cC]ontroller").alias("controllers"), has("[mM]odel|entities").alias("models"), has("[vV]iew|templates").alias("views"), has("domain|entities").alias("domain"),
        has("usecase|use-case|application").alias("use"), has("infra").alias("infra"), has("repositor").alias("repositories"), has("[sS]ervice").alias("services"),
        named("components").alias("components"), named("views").alias("vue_views"), named("store|stores").alias("store"), named("router").alias("router"),
        named("composables").alias("composables"), named("pages").alias("pages"), named("layouts").alias("layouts"),
    )
    c = F.col
    when = lambda x, high, low: F.when(x, high).otherwise(low)
    rules = [
        (c("controllers") & c("models"), "MVC", when(c("views"), 90, 70)),
        (c("domain") & (c("use") | c("infra")), "Clean Architecture", when(c("use") & c("infra"), 85, 60)),
        (c("repositories"), "Repository Pattern", F.lit(80)),
        (c("services"), "Service Layer", F.lit(85)),
        (c("components") & (c("vue_views") | c("pages")) & c("store"), "Vue SPA", when(c("router"), 85, 75)),
        (c("composables"), "Composition API Pattern", F.lit(90)),
        (c("pages") & c("layouts"), "File-based Routing", F.lit(80)),
    ]
    found = F.array(*[F.when(hit, F.struct(F.lit(k).alias("at"), F.lit(name).alias("pattern"), n.alias("confidence"))) for k, (hit, name, n) in enumerate(rules)])
    return a.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("r")).select("r.*").orderBy(F.desc("confidence"), "at").drop("at")


# --- questions ---------------------------------------------------------------


def intent(question: Column) -> Column:
    out = F.lit("general")
    for p, name in reversed(INTENTS):
        out = F.when(question.rlike(p), name).otherwise(out)
    return out


def entities(question: Column) -> Column:
    """Distinct names in a question, in this order: quoted, camelCase, PascalCase, after a keyword, file paths,
    English words for Russian ones, then plain words of 3 letters or more in lower case."""
    all_ = lambda p, g=1: F.regexp_extract_all(question, F.lit(p), F.lit(g))
    plain = F.transform(F.filter(all_(r"(?<![A-Za-z0-9_])([a-zA-Z]{3,})(?![A-Za-z0-9_])"), lambda w: ~F.lower(w).isin(ENTITY_STOP_WORDS)), F.lower)
    known = F.create_map(*[x for words, names in SYNONYMS for w in words.split() for x in (F.lit(w), F.array(*[F.lit(n) for n in names.split()]))])
    russian = F.filter(F.transform(F.regexp_extract_all(F.lower(question), F.lit("([\u0430-\u044f\u0451]+)"), F.lit(1)), lambda w: known[w]), lambda x: x.isNotNull())
    after = all_(r"(?iu)(?:\u0444\u0443\u043d\u043a\u0446\u0438[\u044f\u044e]|\u043c\u0435\u0442\u043e\u0434|\u043a\u043b\u0430\u0441\u0441|\u0444\u0430\u0439\u043b|function|method|class|file)\s+(\w+)")
    found = F.concat(
        all_("[\"'`]([^\"'`]+)[\"'`]"), all_(r"(?<![A-Za-z0-9_])([a-z]+(?:[A-Z][a-z]+)+)(?![A-Za-z0-9_])"), all_(r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[A-Z][a-z]+)+)(?![A-Za-z0-9_])"),
        after, all_(r"(?i)([\w\-./\\]+\.(?:tsx|jsx|ts|js|php|py|vue))"), F.flatten(russian), plain,
    )
    return F.array_distinct(found)


def fuzzy_symbols(symbols: DataFrame, terms: list[str], limit: int | None = 10) -> DataFrame:
    """(id, name, confidence) by the first term with a confidence over 0.3: equal 1, containing the term 0.9, else
    0.5 + 0.3 x the share of the term's parts that a part of the name contains."""
    name = F.lower("name")
    parts = lambda s: F.split(s, "[_-]", -1)

    def score(term: str) -> Column:
        t = F.lit(term.lower())
        theirs = parts(t)
        shared = F.size(F.filter(theirs, lambda q: F.exists(parts(name), lambda x: F.contains(x, q))))
        found = F.when(name == t, 1.0).when(F.contains(name, t), 0.9).when(shared > 0, 0.5 + shared / F.size(theirs) * 0.3)
        return F.when(found > 0.3, found)

    best = F.coalesce(*[score(t) for t in terms], F.lit(None).cast("double"))
    out = symbols.select("id", "name", F.round(best, 6).alias("confidence")).where("confidence is not null")
    return out if limit is None else out.orderBy(F.desc("confidence"), "name", "id").limit(limit)


def relevant_files(files: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """(file_path, score): 0.5 for each term in the path, 0.3 for each in the content."""
    add = lambda c, t, w: F.when(F.contains(F.lower(c), F.lit(t.lower())), w).otherwise(0.0)
    total = sum((add("file_path", t, 0.5) + add("content", t, 0.3) for t in terms), F.lit(0.0))
    return files.select("file_path", F.round(total, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "file_path").limit(limit)


def usages(files: DataFrame, name: str, limit: int | None = 10) -> DataFrame:
    """(file_path, line, text) of lines that have ``name`` as a whole word."""
    rows = files.where(F.contains("content", F.lit(name))).select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("i", "text"))
    p = rf"(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])"
    out = rows.where(F.col("text").rlike(p)).select("file_path", (F.col("i") + 1).alias("line"), "text")
    return out if limit is None else out.orderBy("file_path", "line").limit(limit)


def snippets(files: DataFrame, places: DataFrame, around: int = 3) -> DataFrame:
    """(file_path, line, snippet): numbered lines about each place, the place marked."""
    rows = F.split("content", "\n", -1)
    start = F.greatest(F.lit(1), F.col("line") - around)
    mark = lambda k: F.when(k == F.col("line"), "\u2192").otherwise(" ")
    number = lambda k: F.when(F.length(k.cast("string")) < 4, F.lpad(k.cast("string"), 4, " ")).otherwise(k.cast("string"))
    marked = F.transform(F.slice(rows, start, F.col("line") + around - start + 1), lambda s, i: F.concat(mark(i + start), number(i + start), F.lit("\u2502 "), s))
    return places.join(files, "file_path").select("file_path", "line", F.array_join(marked, "\n").alias("snippet"))


def architecture_files(files: DataFrame, limit: int | None = 15) -> DataFrame:
    hit = reduce(lambda a, b: a | b, [F.col("file_path").rlike(p) for p in ARCHITECTURE_FILES])
    out = files.where(hit).select("file_path")
    return out if limit is None else out.orderBy("file_path").limit(limit)


def files_named(files: DataFrame, terms: list[str], limit: int | None = 10) -> DataFrame:
    """(file_path, relevance): 1 for a path equal to the first term it contains, else 0.5."""
    low = F.lower("file_path")
    score = F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), F.when(low == t.lower(), 1.0).otherwise(0.5)) for t in terms], F.lit(None).cast("double"))
    out = files.select("file_path", score.alias("relevance")).where("relevance is not null")
    return out if limit is None else out.orderBy(F.desc("relevance"), "file_path").limit(limit)


def files_with_issues(issues: DataFrame) -> DataFrame:
    """(file_path, n) of files with findings, most first."""
    return issues.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path")


def main_dependencies(edges: DataFrame, each: int = 5, limit: int | None = 30) -> DataFrame:
    """(src, dst): up to ``each`` edges of entry points and of nodes with more than five."""
    low = F.lower(F.col("src").cast("string"))
    entry = reduce(lambda a, b: a | b, [F.contains(low, F.lit(e)) for e in ENTRY_POINTS])
    rank = F.row_number().over(W.partitionBy("src").orderBy("dst", "type"))
    many = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    out = edges.join(many, "src").where(entry | (F.col("n") > 5)).withColumn("r", rank).where(F.col("r") <= each).select("src", "dst")
    return out if limit is None else out.orderBy("src", "dst").limit(limit)


def file_dependencies(edges: DataFrame, paths: DataFrame, limit: int | None = 20) -> DataFrame:
    """(src, dst) of edges out of ``paths`` (file_path)."""
    out = edges.join(paths.select(F.col("file_path").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    return out if limit is None else out.orderBy("src", "dst").limit(limit)


def callers(edges: DataFrame, file: str, name: str, limit: int | None = 10) -> DataFrame:
    """(src) of nodes with an edge to the file of a symbol, or to a node whose id contains its name."""
    out = edges.where((F.col("dst") == file) | F.contains("dst", F.lit(name))).select("src").distinct()
    return out if limit is None else out.orderBy("src").limit(limit)


# --- documentation -----------------------------------------------------------


#: Route declarations: any receiver, a router, a decorator (fixed values).
ENDPOINTS = [
    r"""(?i)\.(get|post|put|patch|delete)\s*\(\s*['"`]([^'"`]+)['"`]""",
    r"""(?i)router\.(get|post|put|patch|delete)\s*\(\s*['"`]([^'"`]+)['"`]""",
    r"""(?i)@(Get|Post|Put|Patch|Delete)\s*\(\s*['"`]?([^'"`)]*?)['"`]?\s*\)""",
]


def api_endpoints(files: DataFrame, limit: int | None = 50) -> DataFrame:
    """(file_path, method, route) of route declarations in route, controller and api files; a router's match two patterns and are given twice."""
    hit = reduce(lambda a, b: a | b, [F.contains("file_path", F.lit(x)) for x in ("route", "controller", "api")])

    def of(k: int, p: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("m"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("r"))
        return F.transform(both, lambda e, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.upper(e["m"]).alias("method"), F.when(e["r"] == "", "/").otherwise(e["r"]).alias("route")))

    out = files.where(hit).select("file_path", F.explode(F.concat(*[of(k, p) for k, p in enumerate(ENDPOINTS)])).alias("e"))
    out = out if limit is None else out.orderBy("file_path", "e.k", "e.i").limit(limit)
    return out.select("file_path", "e.method", "e.route")


def components(files: DataFrame, most: int = 50) -> DataFrame:
    """(file_path, name, kind, props, emits) of Vue and React components."""
    vue = F.col("file_path").endswith(".vue")
    react = F.col("file_path").rlike(r"\.(tsx|jsx)\z") & F.col("content").rlike(r"(?:function|const)\s+[A-Z]\w*")
    kind = F.when(F.lower("file_path").rlike("/(pages|views)/"), "page").when(F.lower("file_path").rlike("/layouts/"), "layout").otherwise("component")
    props = F.slice(F.array_distinct(F.regexp_extract_all(F.regexp_extract("content", r"(?s)defineProps[^{]*\{(.*?)\}", 1), F.lit(r"(\w+)\??\s*:"), F.lit(1))), 1, 10)
    emits = F.array_distinct(F.regexp_extract_all("content", F.lit(r"""emit\(\s*['"]([\w:-]+)['"]"""), F.lit(1)))
    name = F.regexp_extract("file_path", r"([^/]+)\.\w+\z", 1)
    return files.where(vue | react).select("file_path", name.alias("name"), kind.alias("kind"), props.alias("props"), emits.alias("emits")).orderBy("file_path").limit(most)


# --- exports -----------------------------------------------------------------


def metrics_csv(metrics: DataFrame) -> DataFrame:
    """(line) of the CSV export, without its header."""
    f = F.format_string
    return metrics.select(f('"%s",%d,%d,%d,%d,%d,%.2f,%d,%d,%.2f', "file_path", "total", "code", "comments", "cyclomatic", "cognitive", F.col("maintainability").cast("double"), "afferent", "efferent", "instability").alias("line"))


CSV_HEADER = "File,LOC,SLOC,Comments,Complexity,Cognitive,Maintainability,Afferent,Efferent,Instability"


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    """(id, xml) of GraphML nodes: ids with other signs as _, the base name as label."""
    key = F.regexp_replace(F.col("id").cast("string"), "[^a-zA-Z0-9_]", "_")
    label = xml_escape(F.element_at(F.split("file_path", "/", -1), -1))
    xml = F.concat(F.lit('<node id="'), key, F.lit('"><data key="d0">'), label, F.lit('</data><data key="d1">'), F.col("type"), F.lit("</data></node>"))
    return nodes.select(key.alias("id"), xml.alias("xml"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    """(id, source, target, type) with ids e0, e1, ... in the order of source, target and type.

    Rows are sorted by ranges and stored; each range's ids start from the
    number of rows before it, a sum over as many numbers as there are ranges.
    """
    key = lambda c: F.regexp_replace(F.col(c).cast("string"), "[^a-zA-Z0-9_]", "_")
    rows = edges.select(key("src").alias("source"), key("dst").alias("target"), "type")
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = Table(rows.repartitionByRange(n, "source", "target", "type").withColumn("part", F.spark_partition_id()), "graphml").df
    start, upto = {}, 0
    for part, size in sorted(ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        start[part], upto = upto, upto + size
    if not start:
        return rows.select(F.lit("e0").alias("id"), "source", "target", "type").limit(0)
    before = F.create_map(*[F.lit(x).cast("long") for kv in start.items() for x in kv])[F.col("part").cast("long")]
    k = F.row_number().over(W.partitionBy("part").orderBy("source", "target", "type")) - 1
    return ranged.select(F.concat(F.lit("e"), (before + k).cast("string")).alias("id"), "source", "target", "type")


def relative_paths(df: DataFrame, root: str, *columns: str) -> DataFrame:
    prefix = root.rstrip("/") + "/"
    cut = lambda c: F.when(F.startswith(F.col(c), F.lit(prefix)), F.expr(f"substring({c}, {len(prefix) + 1})")).otherwise(F.col(c))
    return df.withColumns({c: cut(c) for c in columns})


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(at, line) of a GraphML file; lines go by ``at``, then by text."""
    keys = "".join(f'<key id="d{i}" for="{k}" attr.name="{n}" attr.type="string"/>' for i, (k, n) in enumerate((("node", "label"), ("node", "type"), ("edge", "type"))))
    head, tail = f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">', "</graph></graphml>"
    lines = graphml_nodes(nodes).select(F.lit(1).alias("at"), F.col("xml").alias("line"))
    edge = F.concat(F.lit('<edge id="'), "id", F.lit('" source="'), "source", F.lit('" target="'), "target", F.lit('"><data key="d2">'), "type", F.lit("</data></edge>"))
    ends = nodes.sparkSession.createDataFrame([(0, head), (3, tail)], "at int, line string")
    return ends.union(lines).union(graphml_edges(edges).select(F.lit(2).alias("at"), edge.alias("line")))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Write (at, line) as text, in ranges: the parts in the order of their names are the file."""
    lines.repartitionByRange("at", "line").sortWithinPartitions("at", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(folder)


def report(sections: dict[str, DataFrame], form: str = "json", rows: int | None = 20, project: str | None = None) -> str:
    """A report for readers, of the first ``rows`` rows a section (all if None), as json, markdown or html.

    The rows come to the driver: ``Engine.export_to`` writes sections of any size.
    """
    data = {k: [r.asDict(recursive=True) for r in (df if rows is None else df.limit(rows)).collect()] for k, df in sections.items()}
    if form == "json":
        head = {} if project is None else {"projectName": project, "exportDate": datetime.now(UTC).isoformat()}
        return json.dumps(head | data, indent=2, default=str)
    table = lambda rs: (list(rs[0]) if rs else [], [[str(v) for v in r.values()] for r in rs])
    if form == "markdown":
        out = []
        for k, rs in data.items():
            head, body = table(rs)
            out += [f"## {k}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(r) + " |" for r in body), ""]
        return "\n".join(out)
    if form == "html":
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        out = []
        for k, rs in data.items():
            head, body = table(rs)
            cells = lambda t, xs: "<tr>" + "".join(f"<{t}>{esc(x)}</{t}>" for x in xs) + "</tr>"
            out.append(f"<h2>{esc(k)}</h2><table>{cells('th', head)}{''.join(cells('td', r) for r in body)}</table>")
        return "<html><body>" + "".join(out) + "</body></html>"
    raise ValueError(form)


def load_report(text: str) -> tuple[dict, list[str]]:
    """A JSON report and what is wrong with it."""
    try:
        data = json.loads(text)
    except ValueError as e:
        return {}, [str(e)]
    missing = [k for k in ("projectName", "exportDate") if k not in data]
    return data, [f"{k} is missing" for k in missing]
