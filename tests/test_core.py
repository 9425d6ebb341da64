import random

import pytest
from pyspark.sql import functions as F

from kindred.config import Config, load
from kindred.functions import text as T
from kindred.operators import match, score
from kindred.operators.components import connected_components
from kindred.operators.units import prose_files, prose_units
from kindred.plans.engine import analyze
from kindred.plans.report import json_report, text_report
from kindred.plans.session import Session
from kindred.sources import files as S


def test_components_in_rounds_and_in_one_task(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(up)}
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 1 << 18):
        assert {r.node: r.component for r in connected_components(df, few=few).collect()} == want
    assert connected_components(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("intervals", "kept"),
    [([(1, 5), (4, 20), (18, 22)], [(4, 20)]), ([(1, 10), (8, 14), (12, 13)], [(1, 10), (12, 13)]), ([(1, 3)], [(1, 3)]), ([(1, 3), (2, 4)], [(1, 3)])],
)
def test_interval_fold_is_not_gaps_and_islands(spark, intervals, kept):
    df = spark.createDataFrame([([(a, i, b) for i, (a, b) in enumerate(intervals)],)], "x array<struct<start_line:int,unit_idx:bigint,end_line:int>>")
    got = df.select(match.greedy_intervals(F.col("x")).alias("k")).first().k
    assert [(r.start_line, r.end_line) for r in got] == kept


def test_config_checks_and_overrides(tmp_path):
    assert Config().check() == []
    bad = [{"min_statements": 0}, {"min_score": -0.1}, {"min_score": 1.1}, {"level": "bad"}, {"format": "sarif"}, {"min_lines": 0}, {"max_file_size": 0}, {"bands": 5}, {"weight_impact": 0.9}]
    for values in bad:
        assert Config().with_values(values).check(), values
    assert load(str(tmp_path / "none")) == Config()
    (tmp_path / "c.yaml").write_text("# a comment\nmin_statements: 5\nlevel: light\n")
    assert (load(str(tmp_path / "c.yaml")).min_statements, load(str(tmp_path / "c.yaml")).level) == (5, "light")
    assert Config().with_environment(environment={"KINDRED_LEVEL": "semantic", "KINDRED_INCLUDE_TESTS": "false"}).include_tests is False
    with pytest.raises(KeyError):
        Config().with_values({"nope": 1})
    assert [Config(level=x).level_number for x in ("raw", "light", "strong", "semantic", "odd")] == [0, 1, 2, 2, 2]


def test_globs(spark):
    cases = [("a/b/x.pb.go", "**/*.pb.go", True), ("x/obj/y", "**/obj/**", True), ("a/x/obj/y", "**/obj/**", False), ("vendor/y", "vendor/**", True), ("vendor/a/y", "vendor/**", False), ("a/mock_b.go", "**/mock_*.go", True), ("a.min.jsx", "**/*.min.js", False)]
    for path, glob, want in cases:
        assert spark.range(1).select(S.matches_any(F.lit(path), [glob]).alias("m")).first().m is want, (path, glob)


def test_file_predicates(spark):
    at = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert at(S.is_minified(F.lit("a" * 499))) is False and at(S.is_minified(F.lit("a" * 500))) is True
    assert at(S.is_minified(F.lit(("a" * 199 + "\n") * 3))) is False and at(S.is_minified(F.lit(("a" * 200 + "\n") * 3))) is True
    assert at(S.is_generated(F.lit("x" * 2044 + "@generated"))) is False and at(S.is_generated(F.lit("é @generated"))) is True
    assert at(S.region_text(F.lit("a\nb\nc"), 2, 9)) == "b\nc" and at(S.region_text(F.lit("a\nb"), 0, 1)) == "a"
    assert [at(S.language_of(F.lit(p))) for p in ("a.TSX", "b.rake", "c.txt", "d")] == ["javascript", "ruby", None, None]


def test_shingles_and_jaccard(spark):
    df = spark.createDataFrame([(["a"] * 6, ["a"] * 8), (list("abcdefgh"), list("abcdefgx"))], "x array<string>, y array<string>")
    got = df.select(T.shingles(F.col("x"), 7).alias("x"), T.shingles(F.col("y"), 7).alias("y"))
    rows = got.select(F.size("x").alias("a"), F.size("y").alias("b"), T.jaccard(F.col("x"), F.col("y")).alias("j"), T.jaccard(F.col("y"), F.col("x")).alias("k")).collect()
    assert [(r.a, r.b, round(r.j, 4), round(r.k, 4)) for r in rows] == [(0, 1, 0.0, 0.0), (2, 2, 0.3333, 0.3333)]


def test_tokens_as_people_read_them(spark):
    cases = [
        (["func", "$FUNC", "(", "$P0", "int", ",", "$P1", "...", "T", ")", "{", "return", "$P0", ".", "x", "(", ")", ";", "}"], "func $FUNC ($P0 int, $P1 ... T) {return $P0.x (); }".replace("; }", ";}")),
        (["a", ":", "b", "[", "c", "]", "{", "{", "}", "}"], "a:b [ c ] {{}}"),
        ([], ""),
    ]
    rows = spark.createDataFrame([(t,) for t, _ in cases], "t array<string>").select(T.rendered(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [want for _, want in cases]


def _corpus(spark):
    rnd = random.Random(1)
    text = lambda n: "\n".join(" ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randrange(50)) for _ in range(9)) for _ in range(n))
    base, shared = text(12), text(6)
    near = base.replace(base.split("\n")[5], text(1))
    rows = [(1, base), (2, base), (3, near), (4, text(9)), (5, "short"), (6, text(4) + "\n" + shared), (7, text(5) + "\n" + shared), (8, None), (9, "")]
    return spark.createDataFrame([(i, t, "en", "src") for i, t in rows], "doc_id long, text string, lang string, source string")


def test_engine_finds_exact_near_and_window_classes(spark):
    cfg = Config(level="light")
    docs = _corpus(spark)
    files = prose_files(docs)
    result = analyze(files, prose_units(files, cfg), cfg)
    found = result.findings.collect()
    docs_of = lambda f: sorted({int(r.file.split("/")[1].split(".")[0]) for r in f.regions})
    exact = [f for f in found if f.kind == "function" and f.type == "exact"]
    assert [docs_of(f) for f in exact] == [[1, 2]] and exact[0].similarity == 1.0
    merged = [f for f in found if f.kind == "window" and docs_of(f) == [6, 7]]
    assert len(merged) == 2 and sum(not f.suppressed for f in merged) == 1
    best = next(f for f in merged if not f.suppressed)
    assert {(r.end_line - r.start_line) for r in best.regions} == {5}
    s = Session(result)
    page = s.list_findings(limit=1).collect()
    assert len(page) == 1 and s.remaining(limit=1) == sum(not f.suppressed for f in found) - 1
    assert s.explain(page[0].id).first().finding_id == page[0].finding_id
    assert s.compare(page[0].id).count() == page[0].n_regions
    assert "High" in text_report(result) and page[0].id in json_report(result)
    assert score.capped(result.findings, 1).where("not suppressed").count() == 1


def test_results_do_not_depend_on_partitions(spark):
    cfg, docs = Config(level="light"), _corpus(spark)
    files = prose_files(docs.repartition(7))
    units = prose_units(files, cfg)
    once = {tuple(r) for r in match.exact_members(units).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {tuple(r) for r in match.exact_members(prose_units(prose_files(docs), cfg)).collect()} == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_an_analysis_is_made_again_when_its_tables_change(spark, tmp_path):
    from kindred.queries import QUERIES

    lines = [f"w{i} one two three four five six seven" for i in range(12)]
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n in (2, 3):
        docs = [(i, "\n".join(lines), "en", "s") for i in range(n)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for _ in range(2):
            assert max(r.n_functions for r in QUERIES["class_totals"](spark, str(tmp_path)).collect()) == n
