"""All similar pairs: against SQL, in blocks and lists of any length, and without a row for each shingle that two share."""

import random

import duckdb
import numpy as np
import pytest

from kindred.functions import text as T
from kindred.operators import similar
from kindred.queries import ORACLE_SQL, QUERIES

NAME = "shingle_jaccard_pairs"


def _texts(seed=7):
    """Copies but for case and white space, near copies of several lengths, a passage that many share, and odd texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    base, common = [word() for _ in range(60)], [word() for _ in range(30)]
    out = [" ".join(base[:i] + [word()] + base[i + 1 : rng.randrange(45, 60)]) for i in rng.choices(range(45), k=150)]
    out += [" ".join(base).upper().replace(" ", rng.choice(["\n", " \t ", "  "])) for _ in range(23)]
    out += [" ".join([word() for _ in range(rng.randrange(5, 90))] + common) for _ in range(80)]
    out += ["a b c d e f", "a b c d e f g", "A\tB C d e f g ", "a\x0bb c d e f g h i", "a\x0bb c d e f g h i", "É é ß x y z 日本 語", "é É ß X y z 日本 語", "", " \n ", None, None]
    out += ["x " * n for n in (7, 30, 31)] + [" ".join(map(str, range(n))) for n in (16, 21, 22)]  # 10 of 15 and 10 of 16, 15 of 16
    rng.shuffle(out)
    return out


def _both(spark, tmp_path, rows):
    """The query's rows and those of its SQL."""
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(f"SELECT a, b, inter, similarity FROM ({ORACLE_SQL[NAME]}) ORDER BY ALL").fetchall()
    got = QUERIES[NAME](spark, str(tmp_path)).select("a", "b", "inter", "similarity").collect()
    return sorted(map(tuple, got)), want


@pytest.mark.parametrize(("block", "members"), [(256, 256), (8, 4)])
def test_pairs_equal_sql(spark, tmp_path, monkeypatch, block, members):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "MEMBERS", members)
    rows = [(i * 7919 % 10007 - 4000, t) for i, t in enumerate(_texts())] + [(None, "a b c d e f g")]
    got, want = _both(spark, tmp_path, rows)
    assert got == want and len(got) > 4000


def test_a_document_on_several_rows_counts_as_sql_counts_it(spark, tmp_path):
    texts = _texts()[:90]
    rows = [*enumerate(texts), (3, texts[3]), (5, texts[6]), (8, None), (11, texts[3])]
    got, want = _both(spark, tmp_path, rows)
    assert got == want and any(3 in r[:2] for r in got)


def test_no_documents_no_pairs(spark, tmp_path):
    assert _both(spark, tmp_path, []) == ([], [])


def test_a_shared_passage_costs_no_row_for_each_pair(spark, tmp_path):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + " " + passage) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        on = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(on.apply(i).totalShuffleWrite() for i in range(on.size()))

    before = shuffled()
    assert QUERIES[NAME](spark, str(tmp_path)).count() == 0
    assert shuffled() - before < 3 * sum(len(t) for _, t in rows)


def test_overlaps_are_sizes_of_intersections(monkeypatch):
    monkeypatch.setattr(similar, "COLUMNS", 5)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(11)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    assert np.triu(similar.overlaps(sets, 11), 1).tolist() == np.triu(want, 1).tolist()
    assert similar.overlaps(sets, 4).tolist() == [r[4:] for r in want[:4]]
    apart = [np.array([i], np.uint64) for i in range(3)]
    assert similar.overlaps(apart, 1).tolist() == [[0, 0]]


def test_sets_are_those_of_the_column_expressions(spark):
    import pyarrow as pa

    texts = _texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", T.tokens("text").alias("t"))
    want = {r.i: r.n for r in rows.select("i", T.shingles(rows.t, 7).alias("s")).selectExpr("i", "size(s) n").collect() if r.n > 0}
    lower = pa.array([t and t.lower() for t in texts], pa.string())
    assert {int(r): int(n) for at, _, ends in similar.shingle_sets(lower, 7) for r, n in zip(at, np.diff(ends), strict=True)} == want
