"""Dependency-graph queries over nodes (id, type, name, file_path) and edges (src, dst, type).

Traversals are loops of a frontier joined with the edges and anti-joined with
what was seen; every hop is a table of the shared folder, so plans stay short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstack.functions.storage import Table


def _described(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, name, type) of ids, one row for each file, the smallest id first."""
    known = ids.join(nodes, ids.id == nodes.id, "left").select(ids.id, F.coalesce("file_path", ids.id.cast("string")).alias("file"), F.coalesce("name", ids.id.cast("string")).alias("name"), F.coalesce("type", F.lit("file")).alias("type"))
    return known.groupBy("file").agg(F.min_by(F.struct("name", "type"), "id").alias("n")).select("file", "n.name", "n.type")


def dependents_of(edges: DataFrame, nodes: DataFrame, node) -> DataFrame:
    """Files with an edge to ``node``; a self-loop does not count."""
    return _described(edges.where((F.col("dst") == node) & (F.col("src") != F.col("dst"))).select(F.col("src").alias("id")).distinct(), nodes)


def dependencies_of(edges: DataFrame, nodes: DataFrame, node) -> DataFrame:
    """Files that ``node`` has an edge to, itself included."""
    return _described(edges.where(F.col("src") == node).select(F.col("dst").alias("id")).distinct(), nodes)


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, depth): least number of edges from any of ``seeds`` (id) along src -> dst, seeds at 0."""
    front = Table(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "hop")
    seen = [front]
    for d in range(1, hops + 1):
        so_far = reduce(DataFrame.unionAll, [t.df for t in seen])
        step = front.df.join(edges.select("src", "dst"), F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = Table(step.join(so_far.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), "hop")
        seen.append(front)
        if not front.df.limit(1).count():
            break
    return reduce(DataFrame.unionAll, [t.df for t in seen])


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def impact_of(edges: DataFrame, nodes: DataFrame, node, max_depth: int = 5) -> DataFrame:
    """(id, file, name, depth) of what depends on ``node``, without itself."""
    seed = edges.sparkSession.createDataFrame([(node,)], f"id {dict(edges.dtypes)['src']}")
    found = reach(_reversed(edges), seed, max_depth).where("depth > 0")
    return found.join(nodes, "id", "left").select("id", F.coalesce("file_path", F.col("id").cast("string")).alias("file"), F.coalesce("name", F.col("id").cast("string")).alias("name"), "depth")


def transitive_dependencies(edges: DataFrame, node, max_depth: int = 10) -> DataFrame:
    """(id, depth) of what ``node`` depends on within max_depth - 1 hops, without itself."""
    seed = edges.sparkSession.createDataFrame([(node,)], f"id {dict(edges.dtypes)['src']}")
    return reach(edges, seed, max_depth - 1).where("depth > 0")


def shortest_path(edges: DataFrame, start, end) -> DataFrame:
    """(path, length) over edges of either direction, the smallest path by order of ids; no row if there is none.

    Edges go both ways, so a neighbour of a front is in it, in the one before or new.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    both = Table(edges.select("src", "dst").union(_reversed(edges)).distinct(), "both")
    front = Table(spark.createDataFrame([(start, [start])], f"id {kind}, path array<{kind}>"), "path")
    before = None
    while front.df.limit(1).count():
        hit = front.df.where(F.col("id") == end)
        if hit.limit(1).count():
            return hit.select("path", (F.size("path") - 1).alias("length"))
        known = front.df.select("id") if before is None else front.df.select("id").union(before.df.select("id"))
        step = front.df.join(both.df, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("path").alias("p"))
        new = Table(step.select(F.col("dst").alias("id"), F.concat("p", F.array("dst")).alias("path")).join(known, "id", "left_anti"), "path")
        if before is not None:
            before.drop()
        before, front = front, new
    return front.df.select("path", F.lit(0).alias("length"))


def cycles(edges: DataFrame, kind: str | None = "import", longest: int = 6, limit: int | None = 50, self_loops: bool = False) -> DataFrame:
    """(path, length) of simple cycles, each once from its smallest node, by length and path.

    Nodes that can be on no cycle, without an edge in or out, are peeled off
    before paths are grown; a path only goes on to nodes above its start.
    """
    links = edges if kind is None else edges.where(F.col("type") == kind)
    links = Table(links.select("src", "dst").distinct(), "links").df
    for _ in range(3):
        both = links.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        links = Table(both.join(both.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "links").df
    paths = links.where("dst >= src").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("path"))
    found = [paths.where("at = start").select(F.concat("path", F.array("at")).alias("path"))] if self_loops else []
    paths = paths.where("at > start")
    for _ in range(2, longest + 1):
        grown = paths.select("start", F.concat("path", F.array("at")).alias("path"), F.col("at").alias("src")).join(links, "src")
        paths = Table(grown.where((F.col("dst") >= F.col("start")) & ((F.col("dst") == F.col("start")) | ~F.array_contains("path", F.col("dst")))).select("start", F.col("dst").alias("at"), "path"), "cycle").df
        found.append(paths.where("at = start").select(F.concat("path", F.array("at")).alias("path")))
        paths = paths.where("at > start")
    out = reduce(DataFrame.unionAll, found).select("path", (F.size("path") - 1).alias("length")).distinct().orderBy("length", "path")
    return out if limit is None else out.limit(limit)


def hub_files(edges: DataFrame, nodes: DataFrame, limit: int | None = 10) -> DataFrame:
    """(file, dependents, edges) by distinct dependents."""
    counts = edges.groupBy("dst").agg(F.count_distinct("src").alias("dependents"), F.count(F.lit(1)).alias("edges"))
    out = counts.join(nodes, counts.dst == nodes.id, "left").select(F.coalesce("file_path", counts.dst.cast("string")).alias("file"), "dependents", "edges").orderBy(F.desc("dependents"), "file")
    return out if limit is None else out.limit(limit)


def orphan_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, file) of file nodes without an edge."""
    used = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.where("type = 'file'").join(used, "id", "left_anti").select("id", F.col("file_path").alias("file"))


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("type") == "file").alias("file_nodes"), F.count_if(F.col("type") != "file").alias("symbol_nodes"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


def dependent_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, n) edges into each file."""
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).join(nodes, F.col("dst") == nodes.id).groupBy("file_path").agg(F.sum("n").alias("n"))


# --- construction ------------------------------------------------------------

#: Suffixes an import may lack, in order.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.vue"]


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(src, dst) of imports (file_path, source) that resolve to one of ``files`` (file_path).

    Relative and aliased sources are normalised, then the candidates with each
    suffix are joined by equality and the first in order wins.  A source that
    fails so is tried as a path suffix of a file.  Packages do not resolve.
    """
    src = F.col("source")
    target = F.when(src.startswith("."), F.concat(F.regexp_replace("file_path", r"[^/]*\z", ""), src))
    for prefix, to in (aliases if aliases is not None else {"@/": "src/", "~/": ""}).items():
        target = target.when(src.startswith(prefix), F.concat(F.lit(to), F.substring(src, len(prefix) + 1, 4096)))
    target = target.when(src.startswith("/"), src)
    up = F.aggregate(
        F.split(target, "/"),
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == ".") | ((p == "") & (F.size(a) > 0)), a).when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    wanted = imports.select("file_path", "source", F.array_join(up, "/").alias("target")).where("target is not null").distinct()
    candidates = wanted.select("*", F.posexplode(F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat("target", s))).alias("pos", "path"))
    known = files.select(F.col("file_path").alias("path")).distinct()
    exact = candidates.join(known, "path").groupBy("file_path", "source").agg(F.min_by("path", "pos").alias("dst"))
    left = candidates.join(exact.select("file_path", "source"), ["file_path", "source"], "left_anti")
    parts = F.split("path", "/")
    tails = known.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail")).where("tail <> ''")
    loose = left.withColumnRenamed("path", "tail").join(tails, "tail").groupBy("file_path", "source").agg(F.min(F.struct("pos", "path")).alias("m")).select("file_path", "source", F.col("m.path").alias("dst"))
    return exact.union(loose).select(F.col("file_path").alias("src"), "dst", "source")


def import_edges(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    return resolve_imports(imports, files, aliases).select("src", "dst", F.lit("import").alias("type"), F.lit(1.0).alias("weight"))


#: Node types of syntax trees that count twice (fixed values).
BRANCH_TYPES = ["if_statement", "for_statement", "while_statement", "switch_statement", "catch_clause"]


def tree_complexity(declarations: DataFrame) -> DataFrame:
    """(file_path, complexity): one for the root and for each node below it, branches counted twice."""
    return declarations.groupBy("file_path").agg((F.lit(1) + F.count(F.lit(1)) + F.count_if(F.col("type").isin(BRANCH_TYPES))).cast("int").alias("complexity"))


def new_edges(found: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of ``found`` of which ``known`` has none with the same ends, each once."""
    return found.dropDuplicates(["src", "dst"]).join(known.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst", "type", "weight")


#: Symbols of a file that are joined as one row, and edges that a task makes.
BLOCK, EDGES_A_TASK = 256, 1 << 24


def _blocks(symbols: DataFrame, sizes: DataFrame, path: str, ids: str) -> DataFrame:
    """(path, ids): the symbols of a file as arrays of about ``BLOCK`` ids, null ones kept."""
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))
    return symbols.join(sizes, "file_path").groupBy(F.col("file_path").alias(path), block.alias("block")).agg(F.transform(F.collect_list(F.struct("id")), lambda s: s["id"]).alias(ids)).drop("block")


def symbol_import_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from every symbol of a file to the symbols of files whose path contains what it imports.

    Sources are few and distinct ones are held against distinct paths first,
    so the theta join never sees a symbol twice.  There is an edge for each
    pair of symbols, so blocks of symbols are joined and dealt out evenly, by
    the number of edges, and each task then makes its pairs row by row.
    """
    sizes = Table(symbols.where("file_path is not null").groupBy("file_path").agg(F.count(F.lit(1)).alias("n")), "sizes").df
    sources, paths = imports.select("source").where("source <> ''").distinct(), sizes.select(F.col("file_path").alias("path"), F.col("n").alias("m"))
    hits = sources.join(paths, F.contains(F.col("path"), F.col("source")))
    out = Table(imports.select("file_path", "source").distinct().join(hits, "source").join(sizes, "file_path").select("file_path", "path", "n", "m").distinct(), "imported").df
    edges = out.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    tasks = max(symbols.sparkSession.sparkContext.defaultParallelism, min(int(edges / EDGES_A_TASK) + 1, 1 << 15))
    pairs = out.select("file_path", "path").join(_blocks(symbols, sizes, "file_path", "srcs"), "file_path").join(_blocks(symbols, sizes, "path", "dsts"), "path")
    # The step that changes nothing keeps the two generators apart: compiled as one, all edges of a pair would be held at once.
    one = pairs.select("srcs", "dsts").repartition(tasks).select("dsts", F.explode("srcs").alias("src")).coalesce(tasks)
    return one.select("src", F.explode("dsts").alias("dst")).select("src", "dst", F.lit("import").alias("type"), F.lit(1.0).alias("weight"))


def build_graph(files: DataFrame, symbols: DataFrame, imports: DataFrame, declarations: DataFrame | None = None, more: tuple[DataFrame, ...] = (), aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of files and symbols; import edges between files, then ``more`` edges (template, reference, call)."""
    file_nodes = files.select(F.col("file_path").alias("id"), F.lit("file").alias("type"), "file_path", F.element_at(F.split("file_path", "/"), -1).alias("name"), (F.size(F.split("content", "\n", -1)) - 1).alias("lines_of_code"))
    complexity = F.coalesce("complexity", F.lit(1))
    file_nodes = file_nodes.withColumn("complexity", F.lit(1)) if declarations is None else file_nodes.join(tree_complexity(declarations), "file_path", "left").withColumn("complexity", complexity)
    kind = F.when(F.col("kind") == "function", "function").otherwise("class")
    symbol_nodes = symbols.select("id", kind.alias("type"), "file_path", "name", (F.col("end_line") - F.col("start_line")).alias("lines_of_code"), F.lit(None).cast("int").alias("complexity"))
    edges = reduce(DataFrame.unionByName, [m.select("src", "dst", "type", "weight") for m in more], import_edges(imports, files, aliases))
    return file_nodes.unionByName(symbol_nodes), edges


# --- persistence ---------------------------------------------------------------

#: Relation names of stored edges (fixed values).
RELATIONS = {"import": "IMPORTS", "call": "CALLS", "inheritance": "EXTENDS", "composition": "IMPLEMENTS", "uses": "USES", "data_flow": "DATA_FLOW"}


def related(edges: DataFrame) -> DataFrame:
    """Edges with the name of their relation; unknown types are RELATED."""
    name = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])[F.col("type")]
    return edges.withColumn("relation", F.coalesce(name, F.lit("RELATED")))


def sync_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Store the graph; edges are partitioned by relation, so queries on one read only its files."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    related(edges).write.mode("overwrite").partitionBy("relation").parquet(f"{folder}/edges")


def load_graph(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame, column: str = "file_path") -> DataFrame:
    """Rows of ``old`` but for changed files, and rows of ``new`` for those."""
    paths = changed.select(F.col("file_path").alias(column)).distinct()
    return old.join(paths, column, "left_anti").unionByName(new.join(paths, column, "left_semi"))
