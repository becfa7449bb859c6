"""Follow-up questions, diagrams, test stubs and narrative for a project; small inputs, plain text out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstack.operators.graph import reach
from loomstack.operators.relations import routes, stores
from loomstack.operators.reports import api_endpoints, architecture_pattern, components, folder_mix, language_mix, layer_coverage, main_dependencies
from loomstack.operators.security import performance_hints

#: intent: (question, intent, relevance) (fixed values of intent and relevance).
FOLLOW_UPS = {
    "find_symbol": [("Where is {symbol} used?", "find_usage", 0.9), ("Show tests of {symbol}", "find_tests", 0.8), ("Are there problems in {file}?", "find_bugs", 0.7), ("How does {symbol} work?", "explain_flow", 0.6)],
    "find_usage": [("Show the dependency graph of {symbol}", "show_dependencies", 0.9), ("Who else calls {symbol}?", "find_callers", 0.8), ("Can {symbol} be optimised?", "optimize", 0.7)],
    "find_bugs": [("How can this be fixed?", "fix_bug", 0.9), ("Show similar problems", "find_similar_bugs", 0.8), ("Write a test of this case", "generate_test", 0.7)],
    "explain_flow": [("Show a diagram of this flow", "show_diagram", 0.9), ("Where are the bottlenecks?", "find_bottlenecks", 0.8), ("How can this be improved?", "refactor", 0.7)],
    "architecture": [("Show a diagram of the architecture", "show_diagram", 0.9), ("What is wrong with the architecture?", "architecture_issues", 0.8), ("How does the project scale?", "scaling", 0.7)],
    "general": [("Show the project's structure", "architecture", 0.8), ("Find problems in the code", "find_bugs", 0.7), ("What are the project's metrics?", "metrics", 0.6)],
}


def follow_ups(intent: str, symbol: str | None = None, file: str | None = None, issues: int = 0, most: int = 4) -> list[tuple[str, str, float]]:
    """The most relevant next questions."""
    fill = {"symbol": symbol or "this code", "file": (file or "this file").rpartition("/")[2]}
    out = [(q.format(**fill), i, r) for q, i, r in FOLLOW_UPS.get(intent, FOLLOW_UPS["general"])]
    if issues:
        out.append((f"How can the {issues} problems found be fixed?", "fix_bugs", 0.95))
    return sorted(out, key=lambda x: -x[2])[:most]


def dependency_diagram(edges: DataFrame, most: int = 5) -> str:
    """ASCII groups of a file and what it depends on, the largest groups first."""
    groups = edges.groupBy("src").agg(F.count_distinct("dst").alias("n"), F.slice(F.sort_array(F.collect_set("dst")), 1, most).alias("to")).orderBy(F.desc("n"), "src").limit(most)
    return "\n".join("\n".join([f"[{r.src}]", *(f"  +--> {t}" for t in r.to)]) for r in groups.collect())


def architecture_diagram(files: DataFrame, most: int = 8) -> str:
    rows = folder_mix(files).orderBy(F.desc("files"), "folder").limit(most).collect()
    return "\n".join(f"{r.folder or '.'}/  {r.files} files, {r.lines} lines" for r in rows)


def flow_diagram(edges: DataFrame, start: str, depth: int = 3, most: int = 20) -> str:
    """ASCII tree of what ``start`` reaches, by distance, at most ``most`` nodes."""
    seed = edges.sparkSession.createDataFrame([(start,)], f"id {dict(edges.dtypes)['src']}")
    rows = reach(edges, seed, depth).orderBy("depth", "id").limit(most).collect()
    return "\n".join(f"{'  ' * r.depth}{'+--> ' if r.depth else ''}{r.id}" for r in rows)


STUBS = {
    "jest": "describe('{name}', () => {{\n  it('works', () => {{\n    expect({name}()).toBeDefined();\n  }});\n}});\n",
    "pytest": "def test_{name}():\n    assert {name}() is not None\n",
    "phpunit": "public function test{title}(): void\n{{\n    $this->assertNotNull({name}());\n}}\n",
}


def test_stubs(symbols: DataFrame, framework: str = "jest", most: int = 3) -> list[str]:
    """Tests to fill in for the first functions by name."""
    rows = symbols.where("kind = 'function'").select("name").distinct().orderBy("name").limit(most).collect()
    return [STUBS[framework].format(name=r.name, title=r.name[:1].upper() + r.name[1:]) for r in rows]


def narrative(files: DataFrame, name: str = "project") -> str:
    """A paragraph on size and languages."""
    mix = language_mix(files).orderBy(F.desc("files"), "language").limit(4).collect()
    if not mix:
        return f"{name} has no files."
    total = files.agg(F.count(F.lit(1)), F.sum(F.size(F.split("content", "\n", -1)))).first()
    rest = f" It also uses {', '.join(r.language for r in mix[1:])}." if len(mix) > 1 else ""
    return f"{name} has {total[0]} files and {total[1]} lines, mostly {mix[0].language} ({mix[0].share:g}% of files).{rest}"


test_stubs.__test__ = False

#: Advice on an architecture (fixed values).
ADVICE = {
    "critical": "Address {} critical issues first: {}",
    "unclear": "Define clear architectural boundaries - current structure is unclear",
    "repository": "Consider implementing Repository Pattern to separate data access logic",
    "layers": "Structure code into clear layers (Presentation, Business, Data) for better maintainability",
    "god": "Apply Single Responsibility Principle - each module should do one thing well",
}


def architecture_advice(problems: DataFrame, patterns: DataFrame, layers: DataFrame) -> list[str]:
    """What to do about a project, from its problems, layouts and layers."""
    found = [r["title"] for r in problems.where("severity = 'critical'").select("title").limit(100).collect()]
    known = {r["pattern"]: r["confidence"] for r in patterns.collect()}
    holds = {"critical": bool(found), "unclear": max(known.values(), default=0) < 50, "repository": "Repository Pattern" not in known, "layers": layers.count() < 3, "god": "God Object" in found}
    return [ADVICE[k].format(len(found), ", ".join(found)) if k == "critical" else ADVICE[k] for k, on in holds.items() if on]


def markdown_table(df: DataFrame, most: int = 20) -> list[str]:
    """The first rows as lines of a markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: ", ".join(map(str, v)) if isinstance(v, list) else str("" if v is None else v).replace("|", "\\|")
    return ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)] if rows else ["None."]


def documentation(files: DataFrame, edges: DataFrame, name: str = "project", stack: str = "", most: int = 20) -> str:
    """A project's documentation as markdown: overview, languages, structure, architecture, components, endpoints, stores, routes, dependencies."""
    layout = architecture_pattern(files).limit(1).collect()
    sections = {
        "Languages": language_mix(files).orderBy(F.desc("files"), "language"),
        "Structure": folder_mix(files).orderBy(F.desc("files"), "folder"),
        "Layers": layer_coverage(files).orderBy("layer"),
        "Components": components(files),
        "API": api_endpoints(files),
        "State": stores(files).orderBy("file_path"),
        "Routes": routes(files).orderBy("file_path", "route"),
        "Main dependencies": main_dependencies(edges),
    }
    out = [f"# {name}", "", narrative(files, name), ""]
    if stack:
        out += [f"**Stack:** {stack}", ""]
    out += [f"**Architecture:** {layout[0]['pattern']} ({layout[0]['confidence']}%)" if layout else "**Architecture:** Unknown", ""]
    for title, df in sections.items():
        out += [f"## {title}", "", *markdown_table(df, most), ""]
    return "\n".join(out)


def enhance(answer: str, intent: str, question: str, files: DataFrame, edges: DataFrame, symbols: DataFrame, dependencies: DataFrame | None = None, issues: int = 0) -> dict:
    """An answer with follow-ups, diagrams, test stubs and performance hints, as the intent asks for; ``symbols`` are those found."""
    first = symbols.orderBy("file_path", "name").limit(1).collect()
    name, path = (first[0]["name"], first[0]["file_path"]) if first else (None, None)
    looked = intent in ("find_symbol", "explain_flow")
    diagrams = {"dependencies": dependency_diagram(dependencies)} if dependencies is not None and dependencies.limit(1).count() else {}
    if looked and path:
        diagrams["flow"] = flow_diagram(edges, path)
    slow = intent in ("find_bugs", "refactor") or any(w in question.lower() for w in ("performance", "\u043e\u043f\u0442\u0438\u043c\u0438\u0437", "\u0442\u043e\u0440\u043c\u043e\u0437"))
    return {
        "answer": answer, "follow_ups": follow_ups(intent, name, path, issues), "diagrams": diagrams, "tests": test_stubs(symbols) if looked else [],
        "performance": [r.asDict() for r in performance_hints(files).collect()] if slow else [],
    }
