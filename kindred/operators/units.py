"""Units of prose: a document is a function, a line with a token a statement, consecutive statements a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions import text as T

#: Units of one document are numbered within so many.
PER_DOCUMENT = 1 << 20


def numbered(document: Column, ordinal: Column) -> Column:
    """A unit's number; what has no number of its own within a long is an error, not another unit's number."""
    fits = (ordinal < PER_DOCUMENT) & (F.abs(document) < 1 << 43)
    return F.when(fits, document * PER_DOCUMENT + ordinal).otherwise(F.raise_error(F.lit("units of a document, or its number, exceed the range of unit numbers")))


def prose_files(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, file, language, dir, text, is_test, is_generated). Labels stand in for the flags of source files."""
    file = F.concat_ws("", "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("."), "lang")
    out = docs.select("doc_id", file.alias("file"), F.col("lang").alias("language"), F.col("source").alias("dir"), F.coalesce("text", F.lit("")).alias("text"))
    if labels is None:
        return out.withColumns({"is_test": F.lit(False), "is_generated": F.lit(False)})
    flags = labels.groupBy("doc_id").agg((F.max("toxic") == 1).alias("is_test"), (F.min("quality") == 0).alias("is_generated"))
    return out.join(flags, "doc_id", "left")


def statements(text: Column) -> Column:
    """Array of (line, tokens) of the lines that have a token, at light normalization."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.transform(T.tokens(x), T.light).alias("tokens")))
    return F.filter(lines, lambda s: F.size(s["tokens"]) > 0)


def prose_units(files: DataFrame, cfg: Config) -> DataFrame:
    """Functions and windows of files, by the thresholds of cfg."""
    w = cfg.window_size
    held = files.select("doc_id", "file", "dir", statements(F.col("text")).alias("stmts"), F.size(F.split("text", "\n")).alias("n_lines"))
    held = held.withColumn("n", F.size("stmts")).where((F.col("n") >= cfg.min_statements) & (F.col("n_lines") >= cfg.min_lines))
    whole = F.struct(
        F.lit(0).alias("ordinal"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.col("n_lines").alias("end_line"), F.col("n").alias("stmt_count"),
        F.flatten(F.transform("stmts", lambda s: s["tokens"])).alias("tokens"),
    )

    def window(i: Column) -> Column:
        part = F.slice("stmts", i, w)
        toks = F.flatten(F.transform(part, lambda s: s["tokens"]))
        return F.struct(i.alias("ordinal"), F.lit("window").alias("kind"), part[0]["line"].alias("start_line"), part[w - 1]["line"].alias("end_line"), F.lit(w).alias("stmt_count"), toks.alias("tokens"))

    runs = F.when((F.col("n") >= cfg.window_min_function) & (F.col("n") >= w), F.transform(F.sequence(F.lit(1), F.col("n") - (w - 1)), window))
    units = held.select("doc_id", "file", "dir", F.explode(F.concat(F.array(whole), F.coalesce(runs, F.array().cast(_WINDOWS)))).alias("u"))
    out = units.select(numbered(F.col("doc_id"), F.col("u.ordinal")).alias("unit_idx"), "file", "dir", F.lit("body").alias("func_name"), "u.kind", "u.start_line", "u.end_line", "u.stmt_count", "u.tokens")
    out = out.withColumns({"n_tokens": F.size("tokens"), "token_hash": T.token_hash(F.col("tokens"))})
    return out.where((F.col("kind") == "function") | (F.col("n_tokens") >= cfg.min_window_tokens))


_WINDOWS = "array<struct<ordinal:int,kind:string,start_line:int,end_line:int,stmt_count:int,tokens:array<string>>>"
