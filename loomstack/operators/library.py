"""Third-party detection: vendor folder, known pattern, dependency name, minified content; the first that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.functions.libraries import KNOWN, VENDOR_DIRS


def in_vendor_dir(path: Column) -> Column:
    names = "|".join(d.lower().replace(".", r"\.") for d in VENDOR_DIRS)
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(rf"(^|/)({names})/")


def minified(content: Column, size: Column) -> Column:
    """By the first 10240 characters: long lines, two of four shapes without comments, or large without comments."""
    head = F.substring(content, 1, 10240)
    shapes = [r"\w+[=+\-*/&|<>!]=?\w+[=+\-*/&|<>!]=?\w+", r"(?i)(?<![a-z0-9_])[a-z],\s*[a-z],\s*[a-z],\s*[a-z](?![a-z0-9_])", r"\)\.\w+\(\)\.w+\(\)", r"\{[^}]{200,}\}"]
    score = sum((head.rlike(p).cast("int") for p in shapes), F.lit(0))
    comments = F.length(F.array_join(F.regexp_extract_all(head, F.lit(r"(/\*[\s\S]*?\*/|//[^\n]*)"), F.lit(1)), "")) / F.greatest(F.length(head), F.lit(1))
    return (F.length(head) / F.size(F.split(head, "\n", -1)) > 500) | ((comments < 0.02) & (score >= 2)) | ((size > 100 * 1024) & (comments < 0.01))


def library_name(path: Column) -> Column:
    """The last part of a path that is no build folder, without its script extension."""
    skip = ["js", "dist", "build", "src", "lib", "index.js", "main.js"]
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    last = F.element_at(F.filter(parts, lambda p: ~F.lower(p).isin(skip)), -1)
    return F.regexp_replace(F.coalesce(last, F.element_at(parts, -1)), r"(?i)\.(min\.)?(js|mjs|cjs)\z", "")


def detect_libraries(files: DataFrame, dependencies: list[str] = ()) -> DataFrame:
    """(file_path, name, category, detected_by) of files that are not the project's own."""
    path, base = F.col("file_path"), F.element_at(F.split("file_path", "/", -1), -1)
    struct = lambda name, category, by: F.struct(name.alias("name"), F.lit(category).alias("category"), F.lit(by).alias("detected_by"))
    out = F.when(in_vendor_dir(path), struct(library_name(path), "other", "vendor-dir"))
    for row in KNOWN:
        category, name, ps = row.split(" | ")
        p = "|".join(f"(?:{x})" for x in ps.split("  "))
        out = out.when(base.rlike(p) | path.rlike(p), struct(F.lit(name), category, "pattern"))
    if dependencies:
        parts = F.split(path, "/", -1)
        scoped = F.transform(parts, lambda p, i: F.concat_ws("/", p, F.get(parts, i + 1)))
        hit = F.get(F.filter(F.concat(parts, scoped), lambda p: p.isin(list(dependencies))), 0)
        out = out.when(hit.isNotNull(), struct(hit, "other", "package-json"))
    size = F.octet_length("content")
    out = out.when(base.rlike(r"(?i)\.(js|mjs|cjs)\z") & (size < 5 * 1024 * 1024) & minified(F.col("content"), size), struct(library_name(path), "other", "minified"))
    return files.select("file_path", out.alias("l")).where("l is not null").select("file_path", "l.*")


def library_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))


def quick_check(path: Column) -> Column:
    return in_vendor_dir(path) | path.rlike(r"(?i)\.(min|bundle|packed)\.(js|mjs|cjs)\z") | path.rlike(r"(?i)\.[a-f0-9]{8,}\.(js|mjs|cjs)\z")
