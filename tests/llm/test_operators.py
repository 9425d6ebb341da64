"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import bpe, chat_format, decontaminate, jaccard_join, quality, quality_rules, sharding, substring_dedup, token_files, toxicity, transducer

SCHEMA = "doc_id long, text string, _n_words string, n string, c0 string"
VOCABULARY = "the of and Réal été ab cd ef gh ij kl mn op qr st uv wx yz one two".split()


def _texts(seed=1):
    rnd = random.Random(seed)
    words = lambda n: " ".join(rnd.choice(VOCABULARY) + rnd.choice(["", "", str(rnd.randrange(30))]) for _ in range(n))
    base, passage = words(120), words(40)
    near = base.split(" ")
    near[60] = "changed"
    rows = [base, base, " ".join(near), words(80) + "\n" + passage, passage + " " + words(70), None, "", " \n\t", "one", "One", "one two", words(3000), words(25) + " x\x0by", words(12) * 8]
    return [(i, t) for i, t in enumerate(rows + [words(rnd.randrange(1, 90)) for _ in range(20)])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in _texts()] + [(None, "no id at all", None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def _words(t, lower=False):
    raw = (t or "").encode()
    return (bytes(c + 32 if 65 <= c <= 90 else c for c in raw) if lower else raw).split()


def test_substring_dedup(docs, empty):
    seen, want = set(), {}
    for i, t in _texts():
        w = _words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if (k := tuple(w[p : p + 20])) in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        want[i] = len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()
    out = substring_dedup.substring_dedup(docs, 20, digest=True)
    assert out.columns[:5] == docs.columns
    got = {r[0]: tuple(r)[5:] for r in out.collect()}
    assert {i: got[i] for i in want} == want and sum(v[1] for v in want.values()) > 100 and got[None][1] == 0
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize(("k", "num", "block"), [(3, 90, 256), (5, 80, 256), (2, 40, 2)])
def test_jaccard_components(docs, empty, k, num, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    sets = {}
    for i, t in _texts():
        w = _words(t, True)
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k, num, 100).collect()}
    assert {i: got[i] for i in sets} == {i: (len(s), find(i)) for i, s in sets.items()}
    if k == 3:
        assert jaccard_join.jaccard_components(empty).count() == 0


def test_prefix_tree_prunes_nothing_that_links():
    rnd = random.Random(3)
    sets = [np.array(sorted(rnd.sample(range(40), rnd.randrange(1, 30)))) for _ in range(120)]
    tree = jaccard_join.PrefixTree()
    for i, s in enumerate(sets):
        tree.insert(s, i)
    for s in sets:
        mark = np.zeros(40, bool)
        mark[s] = True
        want = {j for j, x in enumerate(sets) if 10 * len(set(s) & set(x)) >= 6 * len(set(s) | set(x))}
        assert set(tree.walk(s, mark, 6, 10)) == want


def test_contamination(spark, docs, empty, monkeypatch):
    texts = dict(_texts())
    items = [(1, " ".join(texts[3].split()[5:30])), (2, "ONE two"), (3, None), (4, ""), (5, "zzz"), (6, "one TWO"), (7, texts[11][200:330])]
    table = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows = {}
    for i, t in items:
        w = split(t)
        for p in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows.setdefault(tuple(w[p : p + 10]), set()).add(str(i))
    want = {}
    for i, t in texts.items():
        w, found = split(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if s := windows.get(tuple(w[p : p + n])):
                    hit[p : p + n] = [True] * n
                    found |= s
        want[i] = len(w), sum(hit), sorted(found)
    for block, passes in ((200_000, 4), (12, 4), (12, 1)):
        monkeypatch.setattr(decontaminate, "ITEM_WORDS", block)
        monkeypatch.setattr(decontaminate, "PASSES", passes)
        out = decontaminate.contamination(docs, table, clean=True)
        got = {r[0]: (tuple(r)[5:8], r[8]) for r in out.collect()}
        assert {i: (a, b, c) for i, ((a, b, c), _) in got.items() if i is not None} == want and sum(v[1] > 0 for v in want.values()) > 3
        assert all(c == texts[i] for i, ((_, n, _), c) in got.items() if i is not None and not n)
    # one word more than the share that is hit, and a null item: its words are hit, but it is not listed
    few = spark.createDataFrame([(0, texts[3]), (1, " ".join(texts[3].split()[5:30]) + " x")], "doc_id long, text string")
    unnamed = table.where("item_id = 1").selectExpr("cast(null as long) as item_id", "text")
    got = {r.doc_id: r for r in decontaminate.contamination(few, unnamed, clean=True, coverage=0.9).collect()}
    assert got[1]._clean == "" and got[0]._clean and got[0]._n_hit == got[1]._n_hit == 25 and not got[0]._items
    assert decontaminate.contamination(few, unnamed, clean=True, coverage=1.0).where("doc_id = 1").first()._clean == " x"
    assert decontaminate.contamination(empty, table).count() == 0
    assert decontaminate.contamination(docs, table.where("false")).where("_n_hit > 0").count() == 0


def test_byte_bpe_and_its_transducer(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rnd = random.Random(2)
    letters = [*"ab stremvlld'''  \n\t,.12#éßİΣ中½", "<|endoftext|>", "the ", " theaa"]
    rows = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(400)] + ["a" * 3000, "", None]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert bpe.frequent_words(table, 10**6) and len(bpe.frequent_words(table, 20)) <= 20
    for lexicon in (0, 50):
        for r in bpe.bpe_round_trip(table, path, lexicon=lexicon).collect():
            want = t.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
            assert r._ids == want and r._n_tokens == len(want) and r._decoded == t.decode(want, skip_special_tokens=False)
    assert bpe.bpe_round_trip(docs, path).count() == docs.count() and bpe.bpe_round_trip(empty, path).count() == 0
    words = sorted({w.encode() for w in ("a", "ab", "abs", "tab", "tabs", "été")})
    lex = transducer.Lexicon(transducer.compile_words(words, [[i, i + 1] for i in range(len(words))]))
    asked = [*words, b"t", b"tabss", b""]
    ends = np.cumsum([0, *map(len, asked)])
    assert lex.ranks(np.frombuffer(b"".join(asked), np.uint8), ends[:-1], ends[1:]).tolist() == [*range(len(words)), -1, -1, -1]
    assert lex.lengths.tolist() == [2] * len(words) and len(lex.final) < sum(map(len, words))  # suffixes are shared


def test_token_files(docs, empty):
    rng = np.random.default_rng(1)
    for n in (0, 1, 1024, 3000):
        x = np.where(rng.random(n) < 0.9, rng.integers(5, 300, n), rng.integers(0, 2**31, n))
        f = token_files.TokenFile(token_files.encode_file(x, np.array([n])))
        assert (f.ids() == x).all() and (f.ids(7, 1500) == x[7:1500]).all()
    path = public_tokenizers.path("word_bpe_49k.json")
    t, start, want = Tokenizer.from_file(path), 0, {}
    rows = [(None, "no id at all"), *_texts()]
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[i] = start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    out = token_files.write_token_files(docs, path).select("doc_ids", "start", "image").mapInArrow(token_files._read, "doc_id long, start long, n long, crc long")
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
    assert token_files.write_token_files(empty, path).count() == 0


def test_chat_format_reads_back(spark):
    rows = [(1, 0, "user", "a\\l<x\\\\"), (1, 1, "user", "</turn>\n<join/>\\g"), (1, 2, "assistant", None), (1, 3, "assistant", "\\<"), (2, 0, "<r>\\g", "q"), (2, 0, "<r>\\g", "q"), (None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(table)
    got = {r.conv_id: [(x.role, x.text) for x in r.t] for r in out.select("conv_id", chat_format.read_chats(F.col("formatted")).alias("t")).collect()}
    for c in (1, 2, None):
        assert got[c] == [(r or "", t or "") for i, _, r, t in rows if i == c]
    assert out.where("conv_id = 1").first().formatted.count("<turn:") == 2
    assert chat_format.format_chats(table.where("false")).count() == 0


def test_shards(spark, docs, empty):
    out = sharding.write_shards(docs, 4, 7)
    rows = out.select("doc_id", "text", "_shard", "_slot").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows) == sorted([(-1, "no id at all"), *((i, t or "") for i, t in _texts())])
    for s in {r._shard for r in rows}:
        assert sorted(r._slot for r in rows if r._shard == s) == list(range(sum(r._shard == s for r in rows)))
    grown = docs.select("doc_id", sharding.shard_of(F.col("doc_id"), 4, 7).alias("a"), sharding.shard_of(F.col("doc_id"), 5, 7).alias("b")).collect()
    assert all(r.a == r.b or r.b == 4 for r in grown)
    assert sharding.write_shards(empty).count() == 0
    # the seed alone fixes the order; names that the input has are given another underscore; ids may be strings
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("_shard"))
    orders = []
    for n in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = sharding.write_shards(named.repartition(n), 4, 7)
        assert out.columns == ["doc_id", "text", "_shard", "__shard", "_bucket", "_slot"]
        orders.append(sorted((r[3], r[5], r[0] or "", r[1] or "") for r in out.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert orders[0] == orders[1] and any(a[2] > b[2] for a, b in zip(orders[0], orders[0][1:]) if a[0] == b[0])


def test_fisher_yates_is_fair(spark):
    out = spark.range(6000).select(sharding._fisher_yates(F.lit(3), F.lit(9), F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(out) == 6 and all(850 < r["count"] < 1150 for r in out)


def test_hot_ids_do_not_swell_the_samples(spark):
    from kindred.llm import samples

    docs = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(0).alias("y"), F.col("id").cast("string").alias("text"))
    ids = samples.at_most(docs.select("doc_id", "y"), 50, 2)
    assert ids.count() == ids.distinct().count() == 50
    assert samples.texts_of(docs, spark.createDataFrame([(7, 0), (8, 0)], "doc_id long, y int")).count() == 2


def test_line_rules(spark, docs, empty):
    def measures(t):
        w = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        keys = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(keys)
        again = {p for i, k in enumerate(keys) if count[k] > 1 for p in (i, i + 1, i + 2)}
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again)

    # docs has columns of the names that are added (_n_words) or used on the way; they pass through by position
    clashing = docs.withColumnRenamed("c0", "words").withColumnRenamed("n", "row")
    out = quality_rules.line_first_cleaning(clashing)
    assert out.columns[:5] == clashing.columns and out.columns[5:10] == ["__n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words"]
    rows = out.collect()
    assert len(rows) == len(_texts()) + 1 and sum(r[9] > 0 for r in rows) > 2
    for r in rows:
        assert tuple(r)[5:10] == measures(r[1]) and (r[0] is None or tuple(r)[2:5] == ("a", "b", "c"))
    line = lambda x: spark.range(1).select(quality_rules.line_fails(F.lit(x)).alias("x")).first().x
    assert [line(x) for x in ("A fine line.", "Home | About | Contact", "Read our Privacy Policy now.", "--- !!", "a " * 12, "a#% b#% c.", "Read our blog in peace.", "To log in, wait.")] == [False, True, True, True, True, True, False, True]
    assert quality_rules.line_first_cleaning(empty.select("doc_id", "text")).count() == 0


def test_classifiers(spark, docs, empty):
    rnd = random.Random(4)
    text = lambda bad: " ".join(rnd.choice(VOCABULARY) if rnd.random() > 0.1 * bad else "nasty" for _ in range(60))
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r._score for r in toxicity.toxicity_scores(table, labels).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows]
    assert sum(right) > 0.97 * len(rows), (sum(right), sorted(got.values())[::60])
    shouted = spark.createDataFrame([(i, t if i % 3 else t.upper() + "!!" * 9) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r._score for r in quality.quality_scores(shouted, labels).collect()}
    assert all((got[i] >= 0.5) == bool(i % 3) for i, _, _ in rows)
    for f in (toxicity.toxicity_scores, quality.quality_scores):
        assert f(empty, labels).count() == 0
        few = f(docs, labels.where("false"))  # nothing to learn from
        assert few.columns == [*docs.columns, "_score"] and few.select("_score").distinct().count() == 1


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in _texts()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(dict(_texts())[3].split()[5:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1 not in got and 2 not in got and {0, 3, 4, 5, 6} <= set(got)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = dict(_texts())
    assert got[0].decoded_sha256 == digest(texts[0]) and got[5].decoded_sha256 == digest("") and got[4].decoded_sha256 != digest(texts[4]) and got[3].decoded_sha256 != digest(texts[3])


def test_the_toxicity_stage_goes_by_the_verdict_of_op1(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = toxicity.op1_toxicity(spark, d).collect()
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, d).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted} and any(0.3 <= r.score < 0.5 for r in rows)


def test_pipeline_stages_take_each_row_as_a_document(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    texts = [" ".join(f"{c}{rnd.randrange(10**6)}" for _ in range(60)) for c in "abcdef"]
    passage = " ".join(texts[0].split()[:30])
    # 1: copies under one doc_id; 2: a near copy of 1 and a text of its own; null: a copy of 3, and one text twice
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0] + " more"), (2, texts[1]), (3, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near = corpus_pipeline.near_copies(spark, docs, "")
    assert near.columns == docs.columns
    assert {tuple(r) for r in near.collect()} == {(1, texts[0]), (2, texts[1]), (3, texts[2]), (None, texts[3]), (None, None)} and near.count() == 5
    rows = [(1, texts[4] + " " + passage), (1, texts[5] + " " + passage), (None, passage + " end"), (None, texts[1]), (7, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    out = [tuple(r) for r in corpus_pipeline.substrings(spark, docs, "").collect()]
    left = [t for i, t, _ in out if i == 1]
    assert sorted(len(t.split()) for t in left) == [60, 90] and all(n == len(t or "") for _, t, n in out)
    assert {(None, "end"), (None, texts[1]), (7, None)} == {(i, t) for i, t, _ in out if i != 1}
