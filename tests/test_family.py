import random

import numpy as np
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions import family, text
from kindred.operators import match
from kindred.operators.units import prose_files, prose_units
from kindred.plans.engine import analyze

WORD = 0xFFFFFFFF


def _mixed(h: int, seed: int) -> int:
    """The mixer in whole numbers, step by step."""
    x = (h & WORD) ^ (h >> 32) ^ seed
    x = x * 0xCC9E2D51 & WORD
    x = (x << 15 | x >> 17) & WORD
    x = x * 0x1B873593 & WORD ^ seed
    x = (x << 13 | x >> 19) & WORD
    return (x * 5 + 0xE6546B64) & WORD


def test_fnv_vectors():
    # published vectors of FNV-1a, 64 bits
    assert [family.fnv1a(x) for x in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


def test_shingles_take_kinds_and_are_distinct():
    toks, kinds = ["if", "x", "é"] * 4, [61, 4, 9] * 4
    got = family.shingle_hashes(toks, kinds, 3, {})
    raw = [k.to_bytes(4, "big") + t.encode() for k, t in zip(kinds, toks, strict=True)]
    want = {family.fnv1a(b"".join(raw[i : i + 3])) for i in range(10)}
    assert {h & (1 << 64) - 1 for h in got} == want and len(got) == 3
    assert got != family.shingle_hashes(toks, None, 3, {})
    assert family.shingle_hashes(toks, kinds, 13, {}) == [] == family.shingle_hashes([], None, 7, {})


def test_minima_and_bands_against_loops():
    rnd = random.Random(3)
    rows = [[rnd.getrandbits(64) for _ in range(n)] for n in (1, 9, 0, 30)]
    signed = np.array([h for r in rows for h in r], np.uint64).view(np.int64)
    bounds = np.cumsum([0, *map(len, rows)])
    sig = family.minima(signed, bounds, 16)
    assert sig.tolist() == [[min((_mixed(h, i) for h in r), default=WORD) for i in range(16)] for r in rows]
    got = family.band_hashes(sig, 5, 4).view(np.uint64)
    for r, hashes in zip(sig.tolist(), got.tolist(), strict=True):
        parts = [b"".join(x.to_bytes(4, "big") for x in r[4 * b : 4 * b + 4]) for b in range(5)]
        assert hashes == [family.fnv1a(p) for p in parts]
    assert hashes[4] == family.FNV_START  # a band without minima


def test_both_families_find_the_near_copies(spark):
    rnd = random.Random(2)
    lines = lambda n: [" ".join(f"w{rnd.randrange(400)}" for _ in range(9)) for _ in range(n)]
    base = lines(14)
    texts = [base, [*base[:13], "an other last line"], lines(14), lines(3)]
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for name in ("portable", "fnv"):
        cfg = Config(level="light", hash_family=name, window_min_function=100)
        files = prose_files(docs)
        found = analyze(files, prose_units(files, cfg), cfg).findings.collect()
        assert [(f.type, sorted(r.unit_idx >> 20 for r in f.regions)) for f in found] == [("near_duplicate", [0, 1])], name
    assert Config(hash_family="odd").check()


def test_shingles_of_units_with_kinds(spark):
    units = spark.createDataFrame([(1, list("abcdefgh"), list(range(8))), (2, list("abc"), [1, 2, 3])], "unit_idx long, tokens array<string>, kinds array<int>")
    rows = match.with_shingles(units, Config(hash_family="fnv")).collect()
    assert [(r.unit_idx, r.shingles) for r in rows] == [(1, family.shingle_hashes(list("abcdefgh"), list(range(8)), 7, {}))]


def test_hash_of_tokens_with_kinds(spark):
    import hashlib

    toks = [(4, "a"), (61, "é"), (-1, "")]
    raw = b"".join((k & WORD).to_bytes(4, "big") + t.encode() + b"\0" for k, t in toks)
    df = spark.createDataFrame([(toks,)], "toks array<struct<kind:int,norm:string>>")
    assert df.select(text.byte_token_hash(F.col("toks")).alias("h")).first().h == hashlib.sha256(raw).hexdigest()
