"""Source files as a DataFrame, and the tests that choose them, as column expressions on paths and contents."""

from __future__ import annotations

import logging
import os
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions.text import base_name

log = logging.getLogger("kindred")

# Fixed values.
EXTENSIONS = {
    ".go": "go", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".mjs": "javascript", ".mts": "javascript",
    ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby", ".m": "objc", ".mm": "objc", ".cs": "csharp",
}
SKIPPED = [".git", ".kindred", "node_modules", "__pycache__", ".bundle", ".next", "dist", "build", "tmp", "log", "coverage"]
GENERATED_MARKS = ["DO NOT EDIT", "auto-generated", "Auto-generated", "Generated by", "@generated"]
GENERATED_GO = r"^// Code generated .* DO NOT EDIT\.$"


def language_of(path: Column) -> Column:
    """The language of a path's extension, null if none has it."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in EXTENSIONS.items()))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def is_pruned(path: Column, cfg: Config) -> Column:
    """Whether a directory of the path is never descended into."""
    names = SKIPPED + ([] if cfg.include_vendor else ["vendor"])
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*names))


def glob_pattern(glob: str) -> str:
    """An anchored pattern; * and ? don't cross a slash, and ** is two stars."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out += "[" + glob[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "".join("\\" + c if not c.isalnum() and c not in "_/" else c)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """A glob matches the path, or its base name, or without **/ its base name."""
    base, out = base_name(path), F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g)) | base.rlike(glob_pattern(g))
        if "**" in g:
            out = out | base.rlike(glob_pattern(g.replace("**/", "", 1)))
    return out


def within_size(files: DataFrame, content: str, most: int) -> DataFrame:
    return files.where(F.octet_length(content) <= most)


def is_minified(content: Column) -> Column:
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (F.octet_length(content) >= 500) & (F.floor(F.octet_length(content) / F.greatest(lines, F.lit(1))) > 200)


def is_generated(content: Column) -> Column:
    """Whether the first 2048 bytes hold a mark; all marks are ASCII, so bytes can be compared."""
    head = F.hex(F.substring(F.encode(content, "UTF-8"), 1, 2048))
    out = F.lit(False)
    for m in GENERATED_MARKS:
        # at an even place, so that the digits are those of whole bytes
        out = out | head.rlike(f"^(?:..)*{m.encode().hex().upper()}")
    return out


def is_generated_go(content: Column) -> Column:
    return F.exists(F.slice(F.split(content, "\n"), 1, 10), lambda x: x.rlike(GENERATED_GO))


def is_test(path: Column, language: Column) -> Column:
    """By the conventions of each language on names and directories."""
    base, low = base_name(path), F.lower(path)
    script = base.rlike(r"\.(test|spec)\.[^.]+$") | path.rlike(r"/(__tests__|__mocks__)/")
    ruby = base.rlike(r"(_test|_spec)\.rb$") | F.startswith(base, F.lit("test_")) | path.rlike(r"/(spec|test)/")
    objc = base.rlike(r"Tests?\.mm?$") | path.rlike(r"/Tests/")
    sharp = base.rlike(r"Tests?\.cs$") | low.rlike(r"/tests?/")
    return (
        F.when(language == "go", base.rlike(r"_test\.go$"))
        .when(language == "javascript", script).when(language == "ruby", ruby).when(language == "objc", objc).when(language == "csharp", sharp).otherwise(False)
    )


def region_text(content: Column, start: int, end: int) -> Column:
    """Lines start to end, within those there are."""
    first = max(1, start)
    return F.array_join(F.slice(F.split(content, "\n"), first, max(0, end - first + 1)), "\n")


def _qualified(spark: SparkSession, root: str):
    """The root as paths of its files begin, or None if it doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at) if fs.exists(at) else None


def linked(top) -> tuple[list[str], list[str]]:
    """Paths under a local root of symlinked files and of symlinked directories; other stores have none."""
    if top.toUri().getScheme() != "file":
        return [], []
    top = top.toUri().getPath()
    files, dirs = [], []
    for folder, subfolders, names in os.walk(top):
        files += [p for n in names if os.path.islink(p := os.path.join(folder, n))]
        dirs += [p for n in subfolders if os.path.islink(p := os.path.join(folder, n))]
    return files, dirs


def read_files(spark: SparkSession, roots: list[str], cfg: Config) -> DataFrame:
    """(root, file, language, content, content_hash, size, is_test, is_generated) of the source files under roots.

    Names and sizes are tested before contents are read: binaryFile takes the filter on length down to the listing.
    Symlinked files are skipped unless follow_symlinks; files below symlinked directories always are. A root that doesn't
    exist has no files; the log says so.
    """
    out = spark.createDataFrame([], "root string, path string, file string, content binary, length long, language string")
    for root in roots:
        top = _qualified(spark, root)
        if top is None:
            log.warning("no such root: %s", root)
            continue
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= cfg.max_file_size)
        path = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:/+", "/")
        file = F.substring("path", len(top.toString().rstrip("/")) + 2, 1 << 30)
        rows = raw.select(F.lit(root).alias("root"), path.alias("path"), file.alias("file"), "content", "length")
        rows = rows.withColumn("language", language_of(F.col("file"))).where(F.col("language").isNotNull() & ~is_pruned(F.col("file"), cfg) & ~matches_any(F.col("file"), list(cfg.exclude)))
        files, dirs = linked(top)
        if files and not cfg.follow_symlinks:
            rows = rows.where(~F.col("path").isin(files))
        for d in dirs:
            rows = rows.where(~F.startswith(F.col("path"), F.lit(d + "/")))
        out = out.unionByName(rows)
    text = F.decode("content", "UTF-8")
    out = out.withColumns({"content_hash": F.sha2("content", 256), "text": text, "is_test": is_test(F.col("path"), F.col("language"))})
    out = out.withColumn("is_generated", F.when(F.col("language") == "go", is_generated_go(F.col("text"))).otherwise(is_generated(F.col("text")))).where(~is_minified(F.col("text")))
    if not cfg.include_tests:
        out = out.where(~F.col("is_test"))
    if not cfg.include_generated:
        out = out.where(~F.col("is_generated"))
    return out.select("root", "file", "language", "text", "content_hash", F.col("length").alias("size"), "is_test", "is_generated")
