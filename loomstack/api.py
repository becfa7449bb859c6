"""Facade over a project: index once, then ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.functions.storage import Table
from loomstack.operators import assist, dead_code, duplication, graph, impact, metrics, parse, relations, reports, rules, search, security
from loomstack.sources import files as src


class Engine:
    """Files, symbols, nodes and edges of a source tree, and the queries over them."""

    def __init__(self, spark: SparkSession, language_model: Callable[[str], str] | None = None):
        self.spark, self.language_model = spark, language_model
        self.files = self.symbols = self.nodes = self.edges = self._index = None
        self.aliases: dict[str, str] | None = None

    def index_project(self, root: str, include: list[str] | None = None, ignore: list[str] = ()) -> Engine:
        """Read a tree and build its relations; each is a table of the shared folder."""
        files = src.read_tree(self.spark, root, include, ignore).select(F.col("relative_path").alias("file_path"), "content", "language")
        configs = {r[0]: r[1] for r in files.where(F.col("file_path").isin("jsconfig.json", "tsconfig.json", "vite.config.ts", "vite.config.js", "vite.config.mjs")).select("file_path", "content").collect()}
        script = next((configs[k] for k in ("tsconfig.json", "jsconfig.json") if k in configs), "")
        self.aliases = src.alias_map(script, "\n".join(v for k, v in sorted(configs.items()) if k.startswith("vite")))
        return self.index_files(files)

    def index_files(self, files: DataFrame) -> Engine:
        """Relations of files (file_path, content)."""
        if "language" not in files.columns:
            files = files.withColumn("language", parse.language_of(F.col("file_path")))
        self.files = Table(files, "files").df
        self.symbols = Table(parse.symbols(parse.parse_declarations(self.files)).withColumn("exports", F.lit(False)), "symbols").df
        exported = self.files.select("file_path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^export\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)"), F.lit(1))).alias("name")).distinct().withColumn("e", F.lit(True))
        self.symbols = Table(self.symbols.drop("exports").join(exported, ["file_path", "name"], "left").withColumn("exports", F.coalesce("e", F.lit(False))).drop("e"), "symbols").df
        nodes, edges = graph.build_graph(self.files, self.symbols, parse.imports(self.files), parse.parse_declarations(self.files), (), self.aliases)
        # Template edges first, then imports of Vue scripts that no edge has yet, then what symbols refer to.
        template = relations.template_edges(self.files)
        vue = self.files.where("file_path like '%.vue'").select("file_path", parse.vue_script(F.col("content")).alias("content"))
        known = Table(edges.unionByName(template), "edges").df
        script = graph.new_edges(graph.import_edges(parse.imports(vue), self.files, self.aliases), known)
        references = relations.reference_edges(parse.references(self.files, self.symbols), self.symbols)
        self.nodes, self.edges = Table(nodes, "nodes").df, Table(known.unionByName(script).unionByName(references), "edges").df
        self._index = None
        return self

    def reindex(self, changed: DataFrame) -> Engine:
        """Replace the files that ``changed`` (file_path, content) names; a null content removes one."""
        kept = self.files.select("file_path", "content").join(changed.select("file_path"), "file_path", "left_anti")
        return self.index_files(kept.unionByName(changed.where("content is not null").select("file_path", "content")))

    def get_dependencies(self, file: str) -> DataFrame:
        return graph.dependencies_of(self.edges, self.nodes, file)

    def get_dependents(self, file: str) -> DataFrame:
        return graph.dependents_of(self.edges, self.nodes, file)

    def get_impact(self, file: str, max_depth: int = 5) -> DataFrame:
        return graph.impact_of(self.edges, self.nodes, file, max_depth)

    def get_cycles(self, limit: int = 50) -> DataFrame:
        return graph.cycles(self.edges, limit=limit)

    def get_path(self, start: str, end: str) -> DataFrame:
        return graph.shortest_path(self.edges, start, end)

    def get_hubs(self, limit: int = 10) -> DataFrame:
        return graph.hub_files(self.edges, self.nodes, limit)

    def get_orphans(self) -> DataFrame:
        return graph.orphan_files(self.edges, self.nodes)

    def get_graph(self) -> tuple[DataFrame, DataFrame]:
        return self.nodes, self.edges

    def get_symbols(self) -> DataFrame:
        return self.symbols

    @property
    def index(self) -> search.SearchIndex:
        """The stored inverted index of the files, built on first use and kept until files change."""
        if self._index is None:
            self._index = search.SearchIndex(self.files)
        return self._index

    def search(self, question: str, limit: int = 20) -> DataFrame:
        return search.search_code(self.files, graph.dependent_counts(self.edges, self.nodes), question, limit, self.index)

    def find_symbol(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name).orderBy("file_path", "start_line").limit(1)

    def find_symbols_in_file(self, file: str) -> DataFrame:
        return self.symbols.where(F.col("file_path") == file)

    def search_symbols(self, question: str, limit: int = 20) -> DataFrame:
        return search.search_symbols(self.symbols, question, limit)

    def get_metrics(self) -> DataFrame:
        return metrics.function_complexity(metrics.file_metrics(self.files, metrics.coupling(self.edges, self.nodes)), self.symbols)

    def get_summary(self) -> DataFrame:
        m = Table(self.get_metrics(), "metrics").df
        return metrics.project_summary(m, metrics.issues(m))

    def get_security_issues(self) -> DataFrame:
        return security.vulnerabilities(self.files)

    def get_secrets(self) -> DataFrame:
        return security.secrets(self.files)

    def get_dead_code(self) -> dict[str, DataFrame]:
        return {
            "unused_exports": dead_code.unused_exports(self.symbols, self.edges), "unused_variables": dead_code.unused_variables(self.files),
            "unreachable": dead_code.unreachable_code(self.files), "empty_blocks": dead_code.empty_blocks(self.files), "commented": dead_code.commented_code(self.files),
        }

    def get_duplication(self) -> DataFrame:
        return duplication.top_clones(duplication.clone_windows(self.files))

    def check_rules(self, engine: rules.RulesEngine | None = None) -> DataFrame:
        return (engine or rules.RulesEngine()).check(rules.Project(self.files, self.symbols, self.nodes, self.edges))

    def get_narrator_report(self) -> dict[str, DataFrame]:
        return {"languages": reports.language_mix(self.files), "layers": reports.layer_coverage(self.files), "patterns": reports.architecture_pattern(self.files), "problems": reports.problems(self.files, self.symbols, self.edges), "large_files": reports.large_files(self.files)}

    def analyze_impact(self, files: list[str] = (), names: list[str] = (), change: str = "modify") -> dict[str, DataFrame]:
        found = Table(impact.affected_nodes(self.edges, self.nodes, impact.changed_nodes(self.nodes, files, names)), "affected").df
        risk = impact.risks(found, change)
        return {"affected": found, "risks": risk, "recommendations": impact.recommendations(found, risk, change), "subgraph": impact.impact_subgraph(self.edges, found)}

    def impact_report(self, description: str, files: list[str] = (), names: list[str] = (), change: str = "modify") -> str:
        got = self.analyze_impact(files, names, change)
        return impact.impact_report(got["affected"], got["risks"], got["recommendations"], description, change, len(files))

    def _sections(self) -> dict[str, DataFrame]:
        m = Table(self.get_metrics(), "metrics").df
        return {
            "summary": metrics.project_summary(m, metrics.issues(m)), "metrics": m, "hotspots": metrics.hotspots(m), "symbols": self.symbols, "nodes": self.nodes, "edges": self.edges,
            "vulnerabilities": self.get_security_issues(), "secrets": self.get_secrets(), "hubs": self.get_hubs(), "cycles": self.get_cycles(), "problems": reports.problems(self.files, self.symbols, self.edges),
        }

    def export(self, form: str = "json", project: str = "project") -> str:
        """A report for readers, as json, markdown or html; lists are cut to their first rows (see ``export_to``)."""
        return reports.report(self._sections(), form, project=project)

    def export_to(self, folder: str, form: str = "json") -> None:
        """All rows, written by executors: JSON lines for each section, the metrics as csv, or the graph as graphml (parts in order)."""
        if form == "json":
            for name, df in self._sections().items():
                df.write.mode("overwrite").json(f"{folder}/{name}")
        elif form == "csv":
            body = reports.metrics_csv(self.get_metrics()).select(F.lit(1).alias("at"), "line")
            reports.write_lines(body.union(self.spark.createDataFrame([(0, reports.CSV_HEADER)], "at int, line string")), folder)
        elif form == "graphml":
            reports.write_lines(reports.graphml(self.nodes, self.edges), folder)
        else:
            raise ValueError(form)

    def context(self, question: str) -> dict[str, DataFrame]:
        """What a question is about, by its intent: symbols, files, dependencies, relations, impact or issues."""
        got = self.spark.range(1).select(reports.intent(F.lit(question)).alias("intent"), reports.entities(F.lit(question)).alias("names")).first()
        intent, names = got["intent"], got["names"]
        found = Table(reports.fuzzy_symbols(self.symbols, names).join(self.symbols.drop("name"), "id"), "found").df
        paths = found.select("file_path").distinct()
        near = self.files.join(paths, "file_path", "left_semi")
        symbols = {"symbols": found}
        related = {"relationships": relations.relationships(near)}
        first = found.orderBy(F.desc("confidence"), "name", "id").first() if intent in ("find_symbol", "find_usage", "refactor", "general") else None
        predicted = {"impact": relations.predicted_impact(self.files, self.edges, first["name"])} if first else {}
        if intent in ("find_symbol", "find_usage"):
            used = {"usages": reports.usages(self.files, first["name"]), "called_by": reports.callers(self.edges, first["file_path"], first["name"])} if first else {}
            return symbols | {"dependencies": reports.file_dependencies(self.edges, paths)} | related | predicted | used
        if intent == "explain_flow":
            chain = graph.reach(self.edges, self.symbols.where(F.col("name").isin(names)).select(F.col("file_path").alias("id")), 3)
            return symbols | {"dependencies": self.edges.join(chain.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"), "files": reports.relevant_files(self.files, names)} | related
        if intent == "find_bugs":
            issues = Table(security.bug_patterns(self.files), "bugs").df
            return {"issues": security.worst(issues, 20), "files": reports.files_with_issues(issues)}
        if intent == "architecture":
            return {"files": reports.architecture_files(self.files), "dependencies": reports.main_dependencies(self.edges)}
        if intent == "find_file":
            return {"files": reports.files_named(self.files, names)}
        if intent == "refactor":
            return symbols | {"issues": security.worst(security.bugs_near(self.files, found), 20)} | related | predicted
        return symbols | {"files": reports.relevant_files(self.files, names)} | (related | predicted if first else {})

    def document(self, name: str = "project") -> str:
        """The project's documentation as markdown."""
        packages = self.files.where("file_path = 'package.json'").select("content").limit(1)
        stack = src.project_stack(packages).select("description").collect()
        return assist.documentation(self.files, self.edges, name, stack[0][0] if stack else "")

    def advice(self) -> list[str]:
        got = self.get_narrator_report()
        return assist.architecture_advice(got["problems"], got["patterns"], got["layers"])

    def enhance(self, question: str) -> dict:
        """The answer to a question with follow-ups, diagrams, test stubs and performance hints."""
        got = self.context(question)
        intent = self.spark.range(1).select(reports.intent(F.lit(question))).first()[0]
        found = got.get("symbols", self.symbols.limit(0))
        return assist.enhance(self.ask(question), intent, question, self.files, self.edges, found, got.get("dependencies"), got["issues"].count() if "issues" in got else 0)

    def ask(self, question: str) -> str:
        """The context of a question as markdown, or what the language model makes of it."""
        text = f"{question}\n" + reports.report(self.context(question), "markdown", 10)
        return self.language_model(text) if self.language_model else text

    def get_status(self) -> DataFrame:
        return graph.graph_stats(self.edges, self.nodes)
