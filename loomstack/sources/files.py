"""Sources: source trees, source maps, package files; globs, languages and hashes of paths."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.functions.languages import EXTENSIONS
from loomstack.functions.text import extension, literal_map
from loomstack.operators.parse import language_of
from loomstack.operators.snapshot import content_hash

MOST_BYTES = 10 << 20
#: Folders and files that no scan enters; more can be given.
IGNORED_DIRS = "node_modules .git .svn .hg dist build out target vendor bower_components .next .nuxt .quasar .cache coverage __pycache__ .venv venv .idea .vscode tmp temp logs".split()
IGNORED_FILES = ["**/*.min.js", "**/*.min.css", "**/*.map", "**/*.lock", "**/package-lock.json", "**/*.log", "**/.DS_Store"]
MAP_SKIPPED = ["node_modules", "webpack/", "(webpack)", "webpack-internal", "vite/", "__vite", "polyfill", "core-js", "regenerator-runtime", "@babel/runtime"]


def glob_to_regex(pattern: str) -> str:
    """``**`` any path, ``*`` within a folder, ``?`` one character; anchored, case-insensitive."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += r"[^/\\]*" if c == "*" else r"[^/\\]" if c == "?" else re.escape(c) if not c.isalnum() and c not in "_/" else c
        i += 1
    return rf"(?i)^{out}\z"


def any_glob(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_to_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def gitignore_patterns(text: str) -> list[str]:
    """Globs of a .gitignore's lines; blank and comment lines are dropped."""
    rows = [x.strip() for x in text.splitlines()]
    return [f"**/{x.strip('/')}" for x in rows if x and not x.startswith("#")]


def is_ignored(path: Column, more: list[str] = ()) -> Column:
    dirs = "|".join(re.escape(d) for d in IGNORED_DIRS)
    return path.rlike(rf"(^|/)({dirs})/") | any_glob(path, [*IGNORED_FILES, *more])


def read_tree(spark: SparkSession, root: str, include: list[str] | None = None, ignore: list[str] = (), with_content: bool = True) -> DataFrame:
    """(file_path, relative_path, content, size, modified, language, content_hash) of the files under ``root``.

    Files over 10 MiB and ignored paths are dropped before contents are decoded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^\w+:(//)?", "")
    base = re.sub(r"^\w+:(//)?", "", root).rstrip("/")
    rows = raw.select(path.alias("file_path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.withColumn("relative_path", F.expr(f"substring(file_path, {len(base) + 2})")).where((F.col("size") <= MOST_BYTES) & ~is_ignored(F.col("relative_path"), list(ignore)))
    known = [e for row in EXTENSIONS for e in row.split(": ")[1].split()]
    rows = rows.where(any_glob(F.col("relative_path"), include) if include else extension(F.col("file_path")).isin(known) | (language_of(F.col("file_path")) != "unknown"))
    out = rows.withColumn("language", language_of(F.col("file_path")))
    if not with_content:
        return out.drop("content")
    text = F.decode("content", "UTF-8")
    return out.withColumn("content_hash", content_hash(text)).withColumn("content", text)


def project_structure(files: DataFrame) -> DataFrame:
    """(folder, files) of the folders that hold files directly."""
    return files.select(F.regexp_replace("file_path", r"/?[^/]*\z", "").alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def source_map_files(maps: DataFrame) -> DataFrame:
    """(file_path, content) of the sources in source maps (map_path, content); of equal paths the first map's counts."""
    parsed = maps.select("map_path", F.from_json("content", "sources array<string>, sourcesContent array<string>, sourceRoot string").alias("m"))
    rows = parsed.select("map_path", "m.sourceRoot", F.posexplode(F.arrays_zip("m.sources", "m.sourcesContent")).alias("i", "s")).where("s.sourcesContent is not null")
    path = F.regexp_replace("s.sources", r"^webpack:///?([^/]*/)?|^file://|^vite:|[?#].*$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"^(\./|\.\./)+", ""), "^/+", "")
    rows = rows.select("map_path", "i", path.alias("file_path"), F.col("s.sourcesContent").alias("content"), F.col("s.sources").alias("raw"))
    skip = F.lit(False)
    for word in MAP_SKIPPED:
        skip = skip | F.col("raw").contains(word)
    known = [e for row in EXTENSIONS for e in row.split(": ")[1].split()]
    rows = rows.where(~skip & (F.col("file_path") != "") & extension(F.col("file_path")).isin(known))
    return rows.withColumn("r", F.row_number().over(W.partitionBy("file_path").orderBy("map_path", "i"))).where("r = 1").select("file_path", "content")


def package_dependencies(packages: DataFrame, content: str = "content") -> DataFrame:
    """(name, version, dev) of package.json contents."""
    p = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    one = lambda c, dev: packages.select(F.explode(p[c]).alias("name", "version"), F.lit(dev).alias("dev"))
    return one("dependencies", False).union(one("devDependencies", True)).distinct()


#: What a dependency says about a project, the first hit of each kind counts (fixed values).
STACK_LADDER = {
    "Frontend": [("Vue.js", "vue @vue/cli"), ("React", "react react-dom"), ("Angular", "@angular/core"), ("Svelte", "svelte"), ("Next.js (React)", "next"), ("Nuxt.js (Vue)", "nuxt"), ("Remix (React)", "@remix-run/react"), ("Vanilla JS (no framework)", "jquery bootstrap tailwindcss @mui/material")],
    "Backend": [("Express", "express"), ("Fastify", "fastify"), ("NestJS", "@nestjs/core"), ("Koa", "koa"), ("Hapi", "hapi")],
    "Database": [("PostgreSQL", "pg postgres"), ("MongoDB", "mongodb mongoose"), ("MySQL", "mysql mysql2"), ("SQLite", "sqlite3 better-sqlite3"), ("Redis", "redis ioredis")],
    "Build": [("Vite", "vite"), ("Webpack", "webpack"), ("Rollup", "rollup"), ("Parcel", "parcel"), ("esbuild", "esbuild")],
}


def project_stack(packages: DataFrame, content: str = "content") -> DataFrame:
    """``packages`` with stack (map of kind to name) and description of each package.json; a null content has neither."""
    p = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    found = {kind: F.coalesce(*[F.when(F.arrays_overlap("__names", F.array(*[F.lit(d) for d in deps.split()])), name) for name, deps in ladder]) for kind, ladder in STACK_LADDER.items()}
    parts = F.array_join(F.array(*[F.concat(F.lit(f"{k}: "), v) for k, v in found.items()]), ", ")
    text = F.when(F.col(content).isNull(), "Unknown stack (package.json not found)").when(parts == "", "Minimal project (no major frameworks)").otherwise(parts)
    stack = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in found]), F.array(*found.values())), lambda k, v: v.isNotNull())
    keyed = packages.withColumn("__names", F.array_distinct(F.concat(*[F.coalesce(F.map_keys(p[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])))
    return keyed.withColumn("stack", F.when(F.col(content).isNotNull(), stack)).withColumn("description", text).drop("__names")


def alias_map(config_text: str = "", vite_text: str = "") -> dict[str, str]:
    """Import prefixes of a jsconfig or tsconfig and of a Vite config, over the defaults ``@/`` and ``~/``."""
    out = {"@/": "src/"}
    try:
        options = json.loads(re.sub(r"(?m)^\s*//.*$", "", config_text)).get("compilerOptions", {})
    except ValueError:
        options = {}
    base = options.get("baseUrl") or "."
    for alias, targets in (options.get("paths") or {}).items():
        if not isinstance(targets, list) or not targets:
            continue
        short = lambda x: x.replace("/*", "/", 1).replace("*", "", 1)
        target = short(targets[0])
        if alias.endswith("$") and "node_modules" in target:
            continue
        out[short(alias.removesuffix("$"))] = (target if base == "." else f"{base}/{target}").removeprefix("./")
    pattern = r"""['"](@/?|~/?)['"]\s*:\s*(?:path\.resolve\s*\([^)]*['"]([^'"]+)['"]\)|['"]\.?/?([^'"]+)['"])"""
    for alias, resolved, plain in re.findall(pattern, vite_text):
        out[alias.rstrip("/") + "/"] = (resolved or plain) + "/"
    return out | {"~/": ""}


def native_language(path: Column) -> Column:
    """The 13 languages of the fast scanner, where .h counts as C++."""
    fixed = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "c": "c", "rb": "ruby", "php": "php", "swift": "swift"}
    return F.coalesce(literal_map(fixed)[extension(path)], F.lit("unknown"))
