"""Relations between files and symbols found in source text: template components, references, inheritance, call chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.operators.graph import reach

#: Tags of HTML and of frameworks that are no components (fixed values).
HTML_TAGS = """
div span p a img ul ol li h1 h2 h3 h4 h5 h6 table tr td th thead tbody tfoot caption colgroup col form input button select
option textarea fieldset legend label section header footer nav main aside article figure figcaption template slot component
transition transition-group keep-alive teleport suspense br hr pre code strong em i b small sub sup mark details summary
dialog menu menuitem video audio source canvas svg path circle rect line g defs use iframe embed object param picture map
area dl dt dd abbr cite blockquote q time var samp kbd ruby rt rp bdi bdo wbr data meter progress output head meta title
link style script noscript body html router-view router-link nuxt nuxt-link nuxt-child
""".split()


def kebab(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2"))


def template_edges(files: DataFrame) -> DataFrame:
    """(src, dst, type, weight): Vue files whose template uses the component of another, by its name or in kebab case."""
    vue = files.where(F.col("file_path").endswith(".vue"))
    name = F.regexp_extract("file_path", r"([^/]+)\.vue\z", 1)
    known = vue.select(F.explode(F.array_distinct(F.array(name, kebab(name)))).alias("tag"), F.col("file_path").alias("dst")).groupBy("tag").agg(F.min("dst").alias("dst"))
    body = F.regexp_extract("content", r"(?s)<template[^>]*>(.*?)</template>", 1)
    tags = F.array_distinct(F.regexp_extract_all(body, F.lit(r"</?([A-Z][a-zA-Z0-9]*|[a-z][a-z0-9]*(?:-[a-z0-9]+)+)[\s/>]"), F.lit(1)))
    good = F.filter(tags, lambda t: ~F.lower(t).isin(HTML_TAGS) & ~t.rlike("^(q|v|el)-"))
    used = vue.select(F.col("file_path").alias("src"), F.explode(good).alias("name"))
    exact = used.join(known, F.col("name") == known.tag).select("src", "name", "dst")
    loose = used.join(exact.select("src", "name"), ["src", "name"], "left_anti").join(known, kebab(F.col("name")) == known.tag).select("src", "name", "dst")
    return exact.union(loose).where("src <> dst").select("src", "dst", F.lit("uses").alias("type"), F.lit(1.0).alias("weight")).distinct()


def reference_edges(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from references (symbol_id, file_path, line, kind): ``uses`` between files, ``call`` to the symbol that a call lies in."""
    own = symbols.select(F.col("id").alias("symbol_id"), F.col("file_path").alias("own"))
    refs = references.join(own, "symbol_id")
    uses = refs.where("file_path <> own").select(F.col("own").alias("src"), F.col("file_path").alias("dst"), F.lit("uses").alias("type")).distinct()
    inside = refs.where("kind = 'call'").join(symbols.select("file_path", F.col("id").alias("dst"), "start_line", "end_line"), "file_path").where("line - 1 between start_line and end_line")
    first = F.row_number().over(W.partitionBy("symbol_id", "file_path", "line").orderBy("start_line", "dst"))
    calls = inside.withColumn("r", first).where("r = 1").select(F.col("symbol_id").alias("src"), "dst", F.lit("call").alias("type")).where("src <> dst").distinct()
    return uses.union(calls).withColumn("weight", F.lit(1.0))


def relationships(files: DataFrame, most: int | None = 50) -> DataFrame:
    """(file_path, kind, subject, object) of imports, exports, calls, extends and implements."""
    c = F.col("content")
    one = lambda p, g=1: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    pair = lambda kind, p: F.transform(F.arrays_zip(one(p, 1).alias("a"), one(p, 2).alias("b")), lambda x: F.struct(F.lit(kind).alias("kind"), x["a"].alias("subject"), x["b"].alias("object")))
    name = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("subject"), x.alias("object")))
    found = F.concat(
        pair("imports", r"""import\s+(\{[^}]+\}|\*\s+as\s+\w+|\w+)\s+from\s+['"]([^'"]+)['"]"""),
        pair("imports", r"""const\s+(\w+)\s*=\s*require\s*\(['"]([^'"]+)['"]\)"""),
        name("exports", one(r"export\s+(?:default\s+)?(?:function|class|const|let|var)\s+(\w+)")),
        name("calls", F.array_distinct(one(r"(?:^|[^.\w])(\w+)\s*\("))),
        pair("extends", r"(?:class|interface)\s+(\w+)\s+extends\s+(\w+)"),
        pair("implements", r"class\s+(\w+)\s+implements\s+(\w+)"),
    )
    out = files.select("file_path", F.explode(F.array_distinct(found)).alias("r")).select("file_path", "r.*")
    return out if most is None else out.orderBy("file_path", "kind", "object", "subject").limit(most)


def call_chain(edges: DataFrame, start, depth: int = 3) -> DataFrame:
    """(id, depth) of what ``start`` calls within ``depth`` steps."""
    seed = edges.sparkSession.createDataFrame([(start,)], f"id {dict(edges.dtypes)['src']}")
    return reach(edges.where("type = 'call'"), seed, depth).where("depth > 0")


def predicted_impact(files: DataFrame, edges: DataFrame, name: str, depth: int = 3, most: int | None = 30) -> DataFrame:
    """(file, level, reasons): files that contain or use a name (1), and those that depend on them (2 and on)."""
    p = rf"(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])"
    has = files.where(F.col("content").rlike(p)).select(F.col("file_path").alias("id")).distinct()
    up = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), has, depth)
    out = up.groupBy(F.col("id").alias("file")).agg((F.min("depth") + 1).alias("level"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("depth") == 0, "contains").otherwise("depends"))), ",").alias("reasons"))
    return out if most is None else out.orderBy("level", "file").limit(most)


# --- stores and routes of front ends ------------------------------------------


def stores(files: DataFrame) -> DataFrame:
    """(file_path, kind, state, actions) of state stores."""
    c = F.col("content")
    kind = F.when(F.contains(c, F.lit("create(")), "zustand").when(F.contains(c, F.lit("makeAutoObservable")), "mobx").when(c.rlike("createSlice|createStore"), "redux").when(F.contains(c, F.lit("defineStore")), "pinia").otherwise("vuex")
    state = F.array_distinct(F.regexp_extract_all(F.regexp_extract(c, r"(?s)state\s*[:(]\s*\(\s*\)\s*=>\s*\(\{([^}]+)\}", 1), F.lit(r"(\w+)\s*:"), F.lit(1)))
    actions = F.array_distinct(F.regexp_extract_all(F.regexp_extract(c, r"(?s)actions\s*:\s*\{([^}]+)\}", 1), F.lit(r"(\w+)\s*\("), F.lit(1)))
    return files.where(F.col("file_path").rlike(r"/stores?(/|\b)|Store\.|\.store\.")).select("file_path", kind.alias("kind"), state.alias("state"), actions.alias("actions"))


def routes(files: DataFrame) -> DataFrame:
    """(file_path, route) of router tables, and of page files where there is none."""
    table = files.where(F.contains("file_path", F.lit("router")) & F.col("file_path").rlike(r"\.(ts|js)\z"))
    declared = table.select("file_path", F.explode(F.regexp_extract_all("content", F.lit(r"""\{\s*path:\s*['"`]([^'"`]+)['"`]"""), F.lit(1))).alias("route"))
    page = F.regexp_replace(F.regexp_replace(F.regexp_extract("file_path", r"/pages/(.*)\.\w+\z", 1), r"(^|/)index\z", ""), r"\[([^\]]+)\]", ":$1")
    paged = files.where(F.contains("file_path", F.lit("/pages/")) & ~F.contains("file_path", F.lit("_"))).select("file_path", F.concat(F.lit("/"), page).alias("route"))
    return declared.union(paged)
