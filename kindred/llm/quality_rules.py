"""Line-first cleaning, with Spark expressions only.

Each line is judged by itself and fails if it
- has no mark of SENTENCE_ENDS at all although it has LONG_LINE words or more,
- has half as many SYMBOLS as words, or more,
- is navigation: it has two separators of NAVIGATION or more, and as many as a fifth of its words,
- is boilerplate: in lower case it has one of the BOILERPLATE phrases, with no letter a to z or digit next to it, or
- has no letter or digit at all, though it has a word.
Failed lines are removed; lines without a word stay as they are. A document is kept if it passes the base rules and if
the lines left hold at least a share MOST_LOST short of all its words.

Base measures (see measures()): n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

Cases: null and empty texts have zero in all measures, no line, and are not kept, as they have fewer than MIN_WORDS
words. Texts of any length are judged whole. Repeated rows are judged alike, null doc_ids like others. Other columns
pass through, whatever their names; those added follow them and are led by an underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.samples import free_names

# Fixed values of the rules.
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SENTENCE_ENDS = ".!?…"
SYMBOLS = "#*$%&|<>"
LONG_LINE = 12
NAVIGATION = "|»›•"
BOILERPLATE = ["lorem ipsum", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "click here", "sign up", "log in", "subscribe to our newsletter"]
MOST_LOST = 0.5

_BLANK = " \t\n\x0b\x0c\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"
_PHRASES = f"(?:^|[^a-z0-9])(?:{'|'.join(BOILERPLATE)})(?:$|[^a-z0-9])"


def _any_of(chars: str) -> str:
    return f"[{chars}]"


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPLIT))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_words(line: Column) -> Column:
    """How many words a line with a word has: one more than its blanks, if each blank is a single space."""
    bare = F.btrim(line, F.lit(_BLANK))
    spaces = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(bare.rlike("[\\x09-\\x0D]|\\x20\\x20"), F.size(F.split(bare, _SPLIT))).otherwise(spaces + 1)


def _may_be_boilerplate(text: Column) -> Column:
    """Whether a text holds the letters of a phrase; a plain search is cheaper than the pattern."""
    return reduce(Column.__or__, (F.contains(F.lower(text), F.lit(x)) for x in BOILERPLATE))


def line_fails(line: Column, n: Column | None = None, boilerplate: bool = True) -> Column:
    """Whether a line with a word fails a rule. n: its words, if they are counted already; boilerplate: whether to look for it.

    Characters are counted only in lines that a pattern finds them in.
    """
    n = line_words(line) if n is None else n
    unfinished = (n >= LONG_LINE) & ~line.rlike(_any_of(SENTENCE_ENDS))
    symbols = line.rlike(_any_of(SYMBOLS)) & (2 * _count(line, SYMBOLS) >= n)
    mark = _any_of(NAVIGATION)
    navigation = line.rlike(f"{mark}.*{mark}") & (_count(line, NAVIGATION) * 5 >= n)
    out = unfinished | symbols | navigation | ~line.rlike("[\\p{L}\\p{N}]")
    return out | F.lower(line).rlike(_PHRASES) if boilerplate else out


#: Columns that measures() and line_first_cleaning() add, and those they need on the way.
_MEASURES = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words"]
_OWN = [*_MEASURES, "_base_failed", "_n_lines", "_n_failed_lines", "_n_words_left", "_clean", "_kept"]


def _measured(text: DataFrame) -> DataFrame:
    """Rows with a column `text` that is not null: its lines with a word, and its measures.

    n_repeat_words counts the words in three-word windows that the text has twice or more. Windows are compared by
    64-bit hashes (of the hashes of both pairs of words) within one text. Sorted by hash and place, a repeated one has
    an equal neighbour; the places found, sorted, cover three words each, or as many as lie before the next place.
    """
    out = text.withColumn("words", words(F.col("text")))
    n = F.size("words")
    hashed = lambda a, b: F.xxhash64(a, b)
    out = out.withColumns(
        {
            "lines": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != ""),
            "_n_words": n.cast("long"),
            "_word_chars": F.length(F.array_join("words", "")).cast("long"),
            "_n_symbols": F.when(F.col("text").rlike(_any_of(SYMBOLS)), _count(F.col("text"), SYMBOLS)).otherwise(0).cast("long"),
            "pairs": F.when(n >= 4, F.zip_with(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1), hashed)),
        }
    ).drop("words")
    n = F.size("pairs")
    out = out.withColumn("windows", F.when(n >= 3, F.zip_with(F.slice("pairs", 1, n - 1), F.slice("pairs", 2, n - 1), hashed))).drop("pairs")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    n = F.size("placed")
    twice = F.zip_with(F.slice("placed", 1, n - 1), F.slice("placed", 2, n - 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    out = out.withColumn("places", F.when(n >= 2, F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))).drop("placed")
    n = F.size("places")
    gaps = F.zip_with(F.slice("places", 2, n - 1), F.slice("places", 1, n - 1), lambda b, a: F.least(b - a, F.lit(3)))
    repeat = F.when(n >= 2, F.lit(3) + F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0)
    return out.withColumns({"_n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "_n_repeat_words": repeat.cast("long")}).drop("places")


def _apart(docs: DataFrame) -> DataFrame:
    """docs as one struct `row` beside `text`, so that no column of docs can clash with those added."""
    return docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def _together(out: DataFrame, columns: list[str], own: list[str]) -> DataFrame:
    return out.select("row.*", *own).toDF(*columns, *free_names(columns, own))


def measures(docs: DataFrame) -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines and _n_repeat_words."""
    return _together(_measured(_apart(docs)), docs.columns, _MEASURES)


def line_first_cleaning(docs: DataFrame) -> DataFrame:
    """docs with the base measures, _base_failed, _n_lines, _n_failed_lines, _n_words_left, _clean (text) and _kept."""
    out = _measured(_apart(docs))
    # counted once a line: within a lambda, an expression is computed as often as it is written
    counted = out.withColumn("counted", F.transform("lines", lambda x: F.struct(x.alias("line"), line_words(x).alias("n"))))
    good = F.when(_may_be_boilerplate(F.col("text")), F.filter("counted", lambda x: ~line_fails(x["line"], x["n"])))
    failed = counted.withColumn("good", good.otherwise(F.filter("counted", lambda x: ~line_fails(x["line"], x["n"], False)))).drop("counted")
    left = failed.withColumns(
        {
            "_n_lines": F.size("lines").cast("long"),
            "_n_failed_lines": (F.size("lines") - F.size("good")).cast("long"),
            "_n_words_left": F.aggregate("good", F.lit(0), lambda a, x: a + x["n"]).cast("long"),
            "_base_failed": (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED_PERCENT * F.col("_n_words")),
            "_clean": F.array_join(F.col("good.line"), "\n"),
        }
    )
    kept = ~F.col("_base_failed") & (F.col("_n_words_left") >= (1 - MOST_LOST) * F.col("_n_words"))
    return _together(left.withColumn("_kept", kept), docs.columns, _OWN)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = line_first_cleaning(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "n_words_left"]
    return out.select("doc_id", *(F.col(f"_{n}").alias(n) for n in names))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, words[i:i + 2] AS win, i FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
good AS (SELECT doc_id, words, text, lines, list_filter(lines, lambda x: NOT (
  (len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) >= 12 AND NOT regexp_matches(x, '[.!?…]'))
  OR 2 * (length(x) - length(translate(x, '#*$%&|<>', ''))) >= len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))
  OR (length(x) - length(translate(x, '|»›•', '')) >= 2 AND 5 * (length(x) - length(translate(x, '|»›•', ''))) >= len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')))
  OR regexp_matches(lower(x), '(?:^|[^a-z0-9])(?:lorem ipsum|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|click here|sign up|log in|subscribe to our newsletter)(?:$|[^a-z0-9])')
  OR NOT regexp_matches(x, '[\p{L}\p{N}]'))) AS good FROM w),
m AS (SELECT g.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, (len(lines) - len(good))::BIGINT AS n_failed_lines,
  coalesce(list_sum(list_transform(good, lambda x: len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')))), 0)::BIGINT AS n_words_left
  FROM good g LEFT JOIN repeated r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_words_left >= n_words AS kept, n_lines, n_failed_lines, n_words_left FROM m
"""
