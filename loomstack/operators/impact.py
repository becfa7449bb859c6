"""Change impact: affected nodes by distance, risks, recommendations, the subgraph; and architecture models."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.operators.graph import reach
from loomstack.operators.rules import back_edges


def changed_nodes(nodes: DataFrame, files: list[str] = (), names: list[str] = ()) -> DataFrame:
    """Ids of nodes that a change names by path, id or symbol name."""
    by_file = F.col("file_path").isin(list(files)) | F.col("id").cast("string").isin(list(files))
    return nodes.where(by_file | ((F.col("type") != "file") & F.col("name").isin(list(names)))).select("id").distinct()


def affected_nodes(edges: DataFrame, nodes: DataFrame, changed: DataFrame, hops: int = 5) -> DataFrame:
    """(id, name, file_path, distance, level), the changed nodes at distance 0."""
    found = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed, hops)
    d = F.col("distance")
    level = F.when(d == 0, "critical").when(d == 1, "high").when(d == 2, "medium").otherwise("low")
    return found.withColumnRenamed("depth", "distance").join(nodes, "id", "left").select("id", "name", "file_path", "distance", level.alias("level"))


#: Risks: id, severity, category, description with its number, what to do (fixed values).
RISKS = [
    ("wide-impact", "high", "breaking_change", "Change affects {} critical components", "Consider breaking into smaller changes"),
    ("deletion-risk", "critical", "breaking_change", "Deletion may break dependent components", "Ensure all dependencies are updated or removed"),
    ("api-change", "high", "compatibility", "Modification may break API contracts", "Review and update all API consumers"),
    ("core-system-risk", "critical", "breaking_change", "Change affects core system components", "Thorough testing required, consider staged rollout"),
]


def risks(affected: DataFrame, change: str = "modify", wide: int = 10) -> DataFrame:
    """(kind, severity, category, description, mitigation, n) of risks that apply to a change, in order; n counts the components at risk."""
    core = F.contains("file_path", F.lit("/core/")) | F.contains("file_path", F.lit("/kernel/"))
    n = affected.agg(F.count_if(F.col("level") == "critical").alias("critical"), F.count_if(F.col("level") == "high").alias("high"), F.count_if(core).alias("core"), F.count(F.lit(1)).alias("n"))
    holds = [(F.col("critical") > wide, "critical"), (F.lit(change == "delete"), "n"), (F.lit(change == "modify") & (F.col("high") > 0), "high"), (F.col("core") > 0, "core")]

    def row(risk: tuple, when: Column, count: str) -> Column:
        kind, severity, category, text, todo = (F.lit(x) for x in risk)
        return F.when(when, F.struct(kind.alias("kind"), severity.alias("severity"), category.alias("category"), F.replace(text, F.lit("{}"), F.col(count).cast("string")).alias("description"), todo.alias("mitigation"), F.col(count).alias("n")))

    found = F.array(*[row(r, *h) for r, h in zip(RISKS, holds, strict=True)])
    return n.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("r")).select("r.*")


def recommendations(affected: DataFrame, found: DataFrame, change: str = "modify") -> DataFrame:
    """(action, priority, description, details) in order."""
    critical = F.when(F.col("level") == "critical", F.struct("id", "name"))
    names = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(critical)), 1, 5), lambda x: x["name"]), ", ")
    severe = F.when(F.col("severity").isin("critical", "high"), F.col("description"))
    a = affected.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "critical").alias("critical"), names.alias("names"), F.count_if(F.contains("file_path", F.lit("test"))).alias("tests"))
    n = a.crossJoin(found.agg(F.array_join(F.collect_list(severe), "; ").alias("severe")))
    row = lambda when, action, priority, text, details: F.when(when, F.struct(F.lit(action).alias("action"), F.lit(priority).alias("priority"), F.lit(text).alias("description"), details.alias("details")))
    every = F.array(
        row(F.lit(True), "review", "critical", "Review all affected components", F.concat(F.col("n").cast("string"), F.lit(" components will be affected by this change"))),
        row(F.col("critical") > 0, "test", "critical", "Test critical components", F.concat(F.lit("Focus on: "), F.col("names"))),
        row(F.col("severe") != "", "check", "critical", "Address high-severity risks", F.col("severe")),
        row(F.col("tests") > 0, "test", "high", "Update affected tests", F.lit("Test files detected in affected nodes")),
        row(F.lit(change == "refactor"), "refactor", "medium", "Consider incremental refactoring", F.lit("Break into smaller, safer changes")),
    )
    return n.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("r")).select("r.*")


def impact_report(affected: DataFrame, found: DataFrame, advice: DataFrame, description: str, change: str = "modify", files: int = 0, most: int = 10) -> str:
    """The impact as markdown: counts, the first ``most`` components of each level, risks and recommendations."""
    levels = ["critical", "high", "medium", "low"]
    counts = {r[0]: r[1] for r in affected.groupBy("level").count().collect()}
    rank = F.row_number().over(W.partitionBy("level").orderBy("distance", F.col("id").cast("string")))
    top: dict[str, list] = {}
    for r in affected.withColumn("r", rank).where(F.col("r") <= most).orderBy("r").collect():
        top.setdefault(r["level"], []).append(r)
    bad, todo = found.collect(), advice.collect()
    out = [f"# Impact Analysis: {description}", "", "## Summary", "", f"- **Change Type:** {change}", f"- **Affected Files:** {files}", f"- **Affected Components:** {sum(counts.values())}", f"- **Risks Identified:** {len(bad)}", "", "## Affected Components", ""]
    for level in (x for x in levels if x in top):
        out += [f"### {level.upper()} Impact ({counts[level]})", "", *(f"- **{r['name']}** ({r['file_path']})" for r in top[level])]
        out += ["", f"... and {counts[level] - most} more"] * (counts[level] > most) + [""]
    out += ["## Risks", ""]
    for r in bad:
        out += [f"### {r['severity'].upper()}: {r['description']}", f"**Category:** {r['category']}", f"**Mitigation:** {r['mitigation']}", ""]
    return "\n".join([*out, "## Recommendations", "", *(f"- **[{r['priority'].upper()}]** {r['description']}\n  {r['details']}" for r in todo)])


def impact_subgraph(edges: DataFrame, affected: DataFrame) -> DataFrame:
    """Edges of which both ends are affected."""
    ids = affected.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


@dataclass
class Context:
    """A bounded context: path parts of its modules, what it depends on and what it must not depend on."""

    name: str
    modules: list[str]
    prohibited: list[str] = field(default_factory=list)
    description: str = ""
    dependencies: list[str] = field(default_factory=list)


@dataclass
class Architecture:
    """Contexts, entities (name, context, properties, relationships), rules (description, severity), invariants; validators add violations."""

    contexts: list[Context] = field(
        default_factory=lambda: [
            Context("Core", ["src/core"], ["src/ui", "src/external"], "Core domain logic"),
            Context("UI", ["src/ui"], ["src/external"], "User interface layer", ["src/core"]),
            Context("External", ["src/external"], ["src/ui"], "External integrations", ["src/core"]),
        ]
    )
    entities: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=lambda: [{"description": "No circular dependencies allowed", "severity": "error"}, {"description": "Follow naming conventions", "severity": "warning"}])
    invariants: list[dict] = field(default_factory=list)
    validators: list[Callable[[DataFrame, DataFrame], DataFrame]] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"boundedContexts": [asdict(c) for c in self.contexts], "entities": self.entities, "rules": self.rules, "invariants": self.invariants}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Architecture:
        """The model of ``to_json``; the default model where the text is none."""
        try:
            data = json.loads(text)
            return cls([Context(**c) for c in data["boundedContexts"]], data.get("entities", []), data.get("rules", []), data.get("invariants", []))
        except (ValueError, TypeError, KeyError):
            return cls()

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model through Spark, so that ``path`` may be in any store it knows."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\0")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Architecture:
        """What ``save`` wrote, or a JSON file; the default model where there is none."""
        try:
            return cls.from_json("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).rstrip("\0"))
        except AnalysisException:
            return cls()

    def report(self) -> str:
        """The model as markdown."""
        out = ["# Architecture Report", "", "## Bounded Contexts", ""]
        for c in self.contexts:
            out += [f"### {c.name}", c.description, "", f"**Modules:** {', '.join(c.modules)}", f"**Dependencies:** {', '.join(c.dependencies) or 'None'}", f"**Prohibited:** {', '.join(c.prohibited) or 'None'}", ""]
        out += ["## Domain Entities", ""]
        for e in self.entities:
            out += [f"### {e['name']}", f"**Context:** {e.get('context', '')}", f"**Properties:** {len(e.get('properties', []))}", f"**Relationships:** {len(e.get('relationships', []))}", ""]
        return "\n".join([*out, "## Rules", "", *(f"- **{r['description']}** ({r['severity']})" for r in self.rules)])


def context_of(files: DataFrame, model: Architecture) -> DataFrame:
    """(file_path, context): the first whose module is a part of the path, or null."""
    out = F.lit(None).cast("string")
    for c in reversed(model.contexts):
        hit = reduce(lambda a, b: a | b, [F.col("file_path").contains(m) for m in c.modules], F.lit(False))
        out = F.when(hit, c.name).otherwise(out)
    return files.select("file_path", out.alias("context"))


def circular(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A validator: (context, source, target) of the edges that close a cycle."""
    return back_edges(edges).select(F.lit("no-circular-deps").alias("context"), F.col("end").cast("string").alias("source"), F.col("start").cast("string").alias("target"))


def isolation_violations(edges: DataFrame, nodes: DataFrame, model: Architecture) -> DataFrame:
    """(context, source, target) of edges into what a context prohibits."""
    n = nodes.select("id", "file_path")
    ends = edges.select("src", "dst").distinct().join(n.select(F.col("id").alias("src"), F.col("file_path").alias("source")), "src").join(n.select(F.col("id").alias("dst"), F.col("file_path").alias("target")), "dst")
    part = lambda col, words: reduce(lambda a, b: a | b, [F.col(col).contains(w) for w in words], F.lit(False))
    hits = F.filter(F.array(*[F.when(part("source", c.modules) & part("target", c.prohibited), F.lit(c.name)) for c in model.contexts]), lambda x: x.isNotNull())
    found = ends.select(F.explode(hits).alias("context"), "source", "target").distinct()
    return reduce(DataFrame.unionByName, [v(edges, nodes) for v in model.validators], found)
