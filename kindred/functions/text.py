"""Tokens and hashes of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modulus of the MinHash permutations; products of two values below it stay within a long.
PRIME = 2**31 - 1


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row. A plain one would be put in place of its name where that is used,
    and inside a lambda be computed again for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[ \\t\\n\\r]+"), lambda t: t != "")


def light(token: Column) -> Column:
    """Numbers and quoted strings by their kind."""
    return F.when(token.rlike("^[0-9]+$"), "$INT").when(token.rlike("^[0-9]+[.][0-9]+$"), "$FLOAT").when(token.rlike('^".*"$'), "$STR").otherwise(token)


def token_hash(toks: Column) -> Column:
    return F.sha2(F.array_join(toks, " "), 256)


def rendered(toks: Column) -> Column:
    """Tokens for people to read: a space between two, but none after { ( . : and none before } ) , ; . :"""
    close = F.transform(toks, lambda t, i: (i == 0) | t.isin(*"}),;.:") | F.coalesce(F.get(toks, i - 1).isin(*"{(.:"), F.lit(False)))
    return F.array_join(F.zip_with(toks, close, lambda t, c: F.when(c, t).otherwise(F.concat(F.lit(" "), t))), "")


def byte_token_hash(toks: Column) -> Column:
    """SHA-256 over each token's kind (four bytes, highest first), its text and a zero byte; toks: array<struct<kind, norm>>."""
    raw = F.transform(toks, lambda t: F.concat(F.lpad(F.hex(t["kind"]), 8, "0"), F.hex(F.encode(t["norm"], "UTF-8")), F.lit("00")))
    return F.sha2(F.unhex(F.array_join(raw, "")), 256)


def shingle(words: Column) -> Column:
    """A 60-bit hash that any engine with MD5 can compute."""
    return F.conv(F.substring(F.md5(F.array_join(words, " ")), 1, 15), 16, 10).cast("long")


def shingles(toks: Column, n: int) -> Column:
    """Distinct hashes of n tokens in a row; none for fewer tokens. (sequence(1, 0) would count down.)"""
    every = F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: shingle(F.slice(toks, i, n)))
    return F.when(F.size(toks) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))


def factors(k: int) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of k permutations modulo PRIME."""
    return [(i * 1103515245 + 12345) % PRIME + 1 for i in range(k)], [(i * 69069 * 69069 + 362437) % PRIME for i in range(k)]


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 if their lengths differ or they are empty."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(".")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
