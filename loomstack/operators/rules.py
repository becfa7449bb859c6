"""Rules engine: a registry of declarative rules, each a DataFrame of violations."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.functions.storage import Table


@dataclass
class Rule:
    id: str
    name: str
    type: str
    severity: str
    enabled: bool = True
    config: dict = field(default_factory=dict)


def default_rules() -> list[Rule]:
    layers = [["domain", "(domain|entities)"], ["application", "(application|usecases|services)"], ["infrastructure", "(infrastructure|adapters)"], ["presentation", "(presentation|controllers|views)"]]
    allowed = {"domain": [], "application": ["domain"], "infrastructure": ["domain", "application"], "presentation": ["domain", "application"]}
    return [
        Rule("no-circular-deps", "No Circular Dependencies", "no-circular", "error"),
        Rule("layer-boundary-clean", "Clean Architecture Layers", "layer-boundary", "error", False, {"layers": layers, "allowed": allowed}),
        Rule("no-utils-in-domain", "No Utils in Domain", "no-import", "warning", True, {"source": "/domain/", "target": "/utils/"}),
        Rule("max-dependencies-10", "Max 10 Dependencies", "max-dependencies", "warning", True, {"max": 10}),
        Rule("max-file-size-500", "Max 500 Lines per File", "max-file-size", "warning", True, {"max": 500}),
        Rule("max-function-length-50", "Max 50 Lines per Function", "max-function-length", "warning", True, {"max": 50}),
        Rule("no-god-class-20", "No God Classes", "no-god-class", "warning", True, {"max": 20}),
        Rule("component-naming", "Component Naming", "naming-convention", "info", False, {"file": r"/components/.*\.(tsx|vue)\z", "pattern": "^[A-Z][a-zA-Z0-9]*\\z"}),
    ]


@dataclass
class Project:
    """What rules look at: files (file_path, content), symbols, nodes and edges."""

    files: DataFrame | None = None
    symbols: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


def _ends(p: Project) -> DataFrame:
    """Edges with the paths of both ends."""
    n = p.nodes.select("id", "file_path")
    return p.edges.join(n.select(F.col("id").alias("src"), F.col("file_path").alias("source")), "src").join(n.select(F.col("id").alias("dst"), F.col("file_path").alias("target")), "dst")


def _layer(path: str, layers: list) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(layers):
        out = F.when(F.lower(path).rlike(pattern), name).otherwise(out)
    return out


def _search(nodes: int, links: int):
    """Edges to a node on the path of a depth-first search, nodes and neighbours in order of number, with the length of the cycle.

    Rows are (node, its neighbours in order) in any order.  Besides one batch it
    holds four bytes for each edge and 16 for each node (24 over 2^31 edges).
    """
    place = "i" if links < 1 << 31 else "q"

    def zeros(kind, n):
        return array(kind, bytes(array(kind).itemsize * n))

    def over(batches):
        dst, first, last = zeros("i", links), zeros(place, nodes), zeros(place, nodes)
        to_dst, to_first, to_last, filled = np.frombuffer(dst, dst.typecode), np.frombuffer(first, place), np.frombuffer(last, place), 0
        for batch in batches:
            node, lists = batch.column(0).to_numpy(), batch.column(1)
            values, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            to_dst[filled : filled + len(values)] = values
            to_first[node], to_last[node] = at[:-1] - at[0] + filled, at[1:] - at[0] + filled
            filled += len(values)
        depth, path, found = zeros("i", nodes), array("i"), array("i")  # depth: 0 unseen, -1 left

        def rows():
            start, end, value = np.array(found, "i").reshape(-1, 3).T
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (start, end, value)], ["start", "end", "value"])

        for root in range(nodes):
            if depth[root]:
                continue
            node, i, stop, level = root, first[root], last[root], 1
            depth[root] = 1
            while True:
                if i == stop:
                    depth[node] = -1
                    if level == 1:
                        break
                    level -= 1
                    node = path.pop()
                    i, stop = first[node], last[node]
                    continue
                to = dst[i]
                i += 1
                seen = depth[to]
                if not seen:
                    first[node] = i
                    path.append(node)
                    level += 1
                    node, i, stop = to, first[to], last[to]
                    depth[to] = level
                elif seen > 0:
                    found.extend((to, node, level - seen + 1))
                    if len(found) >= 3 << 16:
                        yield rows()
                        found = array("i")
        if found:
            yield rows()

    return over


def back_edges(edges: DataFrame) -> DataFrame:
    """(start, end, value) of each cycle of a depth-first search: its first and last node and its length, whatever that is.

    Such a cycle is told by the edge that closes it, so parallel edges count
    once.  The search is sequential and sees all distinct edges in one task;
    nodes are numbered in their order, neighbours gathered and sorted and the
    names put back in all tasks, so that the one task only holds numbers.
    """
    kind = dict(edges.dtypes)["src"]
    links = Table(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    ends = links.df.select(F.col("src").alias("id")).union(links.df.select("dst")).distinct()
    ranged = ends.repartitionByRange("id").sortWithinPartitions("id").select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k"))
    ranged = Table(ranged, "nodes").df
    sizes = dict(ranged.groupBy("part").count().collect())
    before = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1))]
    number = ranged.select("id", (F.element_at(F.lit(before), F.col("part") + 1) + F.col("k")).cast("int").alias("no"))
    named = lambda col, no: number.select(F.col("id").alias(col), F.col("no").alias(no))
    near = links.df.join(named("src", "s"), "src").join(named("dst", "d"), "dst").groupBy("s").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    near = Table(near, "neighbours")
    found = Table(near.df.coalesce(1).mapInArrow(_search(before[-1], links.df.count()), "start int, end int, value int"), "closing").df
    links.drop()
    near.drop()
    out = found.withColumnsRenamed({"start": "s", "end": "e"}).join(named("start", "s"), "s").join(named("end", "e"), "e")
    return out.select(F.col("start").cast(kind), F.col("end").cast(kind), F.col("value").cast("long"))


def _no_circular(p: Project, c: dict) -> DataFrame:
    """One row for each cycle that the search closes."""
    found = back_edges(p.edges.where(F.col("type") == c["edge_type"]) if c.get("edge_type") else p.edges)
    return found.select(F.col("start").cast("string").alias("file"), "value", F.col("end").cast("string").alias("target"))


def _no_import(p: Project, c: dict) -> DataFrame:
    hit = F.col("source").rlike(f"(?i){c['source']}") & F.col("target").rlike(f"(?i){c['target']}")
    return _ends(p).where(hit).groupBy(F.col("source").alias("file"), "target").agg(F.count(F.lit(1)).alias("value")).select("file", "value", "target")


def _layer_boundary(p: Project, c: dict) -> DataFrame:
    rows = _ends(p).withColumn("a", _layer("source", c["layers"])).withColumn("b", _layer("target", c["layers"])).where("a is not null and b is not null and a <> b")
    ok = F.lit(False)
    for a, bs in c["allowed"].items():
        ok = ok | ((F.col("a") == a) & F.col("b").isin(bs))
    return rows.where(~ok).groupBy(F.col("source").alias("file"), "target").agg(F.count(F.lit(1)).alias("value")).select("file", "value", "target")


def _max_dependencies(p: Project, c: dict) -> DataFrame:
    n = p.edges.groupBy("src").agg(F.count(F.lit(1)).alias("value")).where(F.col("value") > c["max"])
    return n.join(p.nodes, n.src == p.nodes.id).select(F.col("file_path").alias("file"), "value", F.lit(None).cast("string").alias("target"))


def _max_file_size(p: Project, c: dict) -> DataFrame:
    size = F.size(F.split("content", "\n", -1)).cast("long")
    return p.files.select(F.col("file_path").alias("file"), size.alias("value"), F.lit(None).cast("string").alias("target")).where(F.col("value") > c["max"])


def _max_function_length(p: Project, c: dict) -> DataFrame:
    rows = p.symbols.where("kind = 'function'").select(F.col("file_path").alias("file"), (F.col("end_line") - F.col("start_line")).cast("long").alias("value"), F.col("name").alias("target"))
    return rows.where(F.col("value") > c["max"])


def _no_god_class(p: Project, c: dict) -> DataFrame:
    classes = p.symbols.where("kind = 'class'").groupBy(F.col("name").alias("target")).agg(F.min("file_path").alias("file"))
    functions = p.symbols.where("kind = 'function'").groupBy(F.col("file_path").alias("file")).agg(F.count(F.lit(1)).alias("value")).where(F.col("value") > c["max"])
    return classes.join(functions, "file").select("file", "value", "target")


def _naming(p: Project, c: dict) -> DataFrame:
    bad = F.col("exports") & F.col("file_path").rlike(c["file"]) & ~F.col("name").rlike(c["pattern"])
    return p.symbols.where(bad).select(F.col("file_path").alias("file"), F.lit(1).cast("long").alias("value"), F.col("name").alias("target"))


KINDS: dict[str, Callable[[Project, dict], DataFrame]] = {
    "no-circular": _no_circular, "no-import": _no_import, "layer-boundary": _layer_boundary, "max-dependencies": _max_dependencies,
    "max-file-size": _max_file_size, "max-function-length": _max_function_length, "no-god-class": _no_god_class, "naming-convention": _naming,
}
#: What a rule type reads; a rule whose relation is missing finds nothing.
_NEEDS = {"max-file-size": "files", "max-function-length": "symbols", "no-god-class": "symbols", "naming-convention": "symbols"}


class RulesEngine:
    """Add, remove, toggle, export and import rules, and check a project; custom types are callables."""

    def __init__(self, rules: list[Rule] | None = None, custom: dict[str, Callable[[Project, dict], DataFrame]] | None = None):
        self.rules = {r.id: r for r in (default_rules() if rules is None else rules)}
        self.kinds = KINDS | (custom or {})

    def add(self, rule: Rule) -> None:
        self.rules[rule.id] = rule

    def remove(self, rule_id: str) -> bool:
        return self.rules.pop(rule_id, None) is not None

    def toggle(self, rule_id: str, enabled: bool) -> bool:
        if rule_id in self.rules:
            self.rules[rule_id].enabled = enabled
        return rule_id in self.rules

    def enabled(self) -> list[Rule]:
        return [r for r in self.rules.values() if r.enabled]

    def to_json(self) -> str:
        return json.dumps([asdict(r) for r in self.rules.values()], indent=2)

    def load_json(self, text: str) -> int:
        rules = [Rule(**r) for r in json.loads(text)]
        self.rules |= {r.id: r for r in rules}
        return len(rules)

    def check(self, project: Project) -> DataFrame:
        """(rule, severity, file, value, target) of all violations of enabled rules."""
        found = []
        for r in self.enabled():
            if r.type in self.kinds and getattr(project, _NEEDS.get(r.type, "edges")) is not None:
                found.append(self.kinds[r.type](project, r.config).select(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), "file", "value", "target"))
        if not found:
            raise ValueError("no enabled rule applies")
        return reduce(DataFrame.unionAll, found)


def summary(violations: DataFrame) -> DataFrame:
    """(errors, warnings, infos, passed)."""
    n = violations.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")])
    return n.withColumn("passed", F.col("errors") == 0)
