"""The registered queries themselves, each contract column, on small tables with nulls, ties, repeated texts and hot passages."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_operators import _texts, _words
from tokenizers import Tokenizer

from kindred.llm import registry, toxicity
from kindred.llm.quality import Discriminant

PASSAGE = " ".join(f"hot{i}" for i in range(26))
ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "ONE two"), (3, None), (4, ""), (10, "alpha BETA gamma delta epsilon zeta eta theta iota kappa")]


def _rows():
    rnd = random.Random(8)
    out = _texts()
    n = len(out)
    out += [(n + i, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randrange(9))) + " " + PASSAGE + f" tail{i}") for i in range(30)]
    out += [(n + 30, ITEMS[0][1] + " and more"), (n + 31, "x " + ITEMS[0][1][6:]), (n + 32, None), (n + 33, "a|b » c\n\n- # 3.5$ <x>\nlog in\tnow " + "word " * 60), (n + 34, "naïve ÉTÉ <|endoftext|> ½ 'll don't 　x")]
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = _rows()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(len(t or "") > 200), int("hot" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    chats = [(1, 0, "user", "</turn> \\### hi"), (1, 1, "assistant", "ok\n<join/>"), (1, 2, "assistant", None), (2, 0, "system", ""), (2, 1, "user", "é½")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def _got(spark, corpus, number):
    name, f = next((n, f) for n, f in registry.QUERIES.items() if n.startswith(f"op{number}_"))
    out = f(spark, corpus)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(_rows()), name
    return out.columns, rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_with_sql(spark, corpus, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{corpus}/{t}.parquet/*.parquet'")
    got, df = c.execute(registry.ORACLE_SQL[name]), registry.QUERIES[name](spark, corpus)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(v for _, v in sorted(zip(names, r))) for r in got.fetchall())
    assert Counter(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize(("number", "folds", "fold", "least"), [(1, 4, 2, 0.3), (2, 3, 1, 0.5)])
def test_scores(spark, corpus, number, folds, fold, least):
    columns, rows = _got(spark, corpus, number)
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_toxicity_catches_what_is_held_out(spark, corpus):
    rows, texts = _got(spark, corpus, 1)[1], dict(_rows())
    hot = [r.score for i, r in rows.items() if r.held_out and "hot" in (texts[i] or "")]
    cold = [r.score for i, r in rows.items() if r.held_out and "hot" not in (texts[i] or "")]
    assert hot and cold and min(hot) > max(cold)


def test_training_lowers_the_non_negative_risk():
    """Against the risk of the start, worked out by a plain formula, for a prior on each side of the clamp."""
    rng = np.random.default_rng(3)
    positive = [np.unique(rng.integers(0, 6, 3)).astype(np.int32) for _ in range(40)]
    unlabelled = [np.unique(rng.integers(0, 9, 3)).astype(np.int32) for _ in range(60)]

    def parts(w, bias, prior):
        g = [np.array([w[x].sum() + bias for x in rows]) for rows in (positive, unlabelled)]
        return prior * np.logaddexp(0, -g[0]).mean(), np.logaddexp(0, g[1]).mean() - prior * np.logaddexp(0, g[0]).mean()

    for prior in (0.3, 0.95):
        w, bias = toxicity.fit(positive, unlabelled, prior, epochs=1, batch=1 << 20)
        toxic, clean = parts(w, bias, prior)
        start = parts(np.zeros(len(w)), np.log(prior / (1 - prior)), prior)
        assert np.isfinite(w).all() and toxic + max(0, clean) <= start[0] + max(0, start[1]) + 1e-9


@pytest.mark.parametrize("shift", [1.0, -6.0])
def test_slopes_are_differences_of_the_risk(shift):
    """On both sides of the clamp, each slope against a central difference of the plain formulas."""
    rng = np.random.default_rng(5)
    gp, gu, prior, step = rng.normal(size=7) + 1, rng.normal(size=9) + shift, 0.4, 1e-5

    def clean(a, b):
        return sum(math.log1p(math.exp(x)) for x in b) / len(b) - prior * sum(math.log1p(math.exp(x)) for x in a) / len(a)

    def left(a, b):
        toxic = prior * sum(math.log1p(math.exp(-x)) for x in a) / len(a)
        return toxic + clean(a, b) if shift > 0 else -clean(a, b)

    assert (clean(gp, gu) >= 0) == (shift > 0)
    for which, got in enumerate(toxicity.slopes(gp, gu, prior)):
        for i, slope in enumerate(got):
            more, less = [gp.copy(), gu.copy()], [gp.copy(), gu.copy()]
            more[which][i] += step
            less[which][i] -= step
            assert abs((left(*more) - left(*less)) / (2 * step) - slope) < 1e-7


def test_discriminant_equals_dense_formulas():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + y[:, None] * [1, 0, -1, 0.5]
    d, new = Discriminant(x, y), rng.normal(size=(50, 4)) * 2
    z = (new - d.mean) / d.scale
    logs = []
    for center, inverse, _ in d.parts:
        s = np.linalg.inv(inverse.T @ inverse)
        share = (y == len(logs)).mean()
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z - center, np.linalg.inv(s), z - center) - 0.5 * np.linalg.slogdet(s)[1] + np.log(share))
    assert np.allclose(d.scores(new), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_token_files_query(spark, corpus):
    rows, t, start = _got(spark, corpus, 4)[1], Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for i, text in sorted(_rows()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        r = rows[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_sharding_query(spark, corpus):
    rows = _got(spark, corpus, 6)[1]
    for i, t in _rows():
        raw = (t or "").encode()
        r = rows[i]
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    for s in {r.shard for r in rows.values()}:
        slots = sorted(r.slot for r in rows.values() if r.shard == s)
        assert slots == list(range(len(slots)))


def test_decontamination_query(spark, corpus):
    rows = _got(spark, corpus, 7)[1]
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows: dict = {}
    for i, t in ITEMS:
        w = split(t)
        for p in range(max(0, len(w) - 10) + 1) if w else ():
            windows.setdefault(tuple(w[p : p + 10]), set()).add(str(i))
    hits = 0
    for i, t in _rows():
        w, found = split(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if s := windows.get(tuple(w[p : p + n])):
                    hit[p : p + n] = [True] * n
                    found |= s
        r, n = rows[i], sum(hit)
        hits += n > 0
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), n, len(found), n > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r.copied == (n > 0.8 * len(w))
    assert hits > 3


def test_bpe_query(spark, corpus):
    rows, t = _got(spark, corpus, 8)[1], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    for i, text in _rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), *want)


def test_jaccard_query(spark, corpus):
    columns, rows = _got(spark, corpus, 9)
    assert columns == ["doc_id", "n_shingles", "component_id"]
    sets = {}
    for i, t in _rows():
        w = _words(t, True)
        sets[i] = {tuple(w[p : p + 3]) for p in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_substring_query(spark, corpus):
    rows, seen = _got(spark, corpus, 10)[1], set()
    for i, t in sorted(_rows()):
        w = _words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if (k := tuple(w[p : p + 20])) in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        r = rows[i]
        assert (r.n_words, r.n_removed) == (len(w), sum(gone))
        assert r.kept_sha256 == hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()
    assert sum(r.n_removed > 0 for r in rows.values()) >= 29 and not any(math.isnan(r.n_words) for r in rows.values())
