"""Queries over the driver's tables, one or more for each operator, and DuckDB SQL with the same results.

Documents stand in for source files: a document is a function, a line a statement, five lines in a row a window, its
source the directory, and labels the flags of files. Paths of pages stand in for paths of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import oracle
from kindred.config import Config
from kindred.functions import text as T
from kindred.operators import match, score
from kindred.operators.components import connected_components
from kindred.operators.similar import similar_pairs
from kindred.operators.units import prose_files, prose_units, statements
from kindred.plans.engine import ScanResult, analyze
from kindred.plans.session import Session
from kindred.plans.storage import Scratch
from kindred.sources import files as S

CFG = Config(level="light")
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _files(spark, d) -> DataFrame:
    return prose_files(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def _units(spark, d) -> DataFrame:
    return prose_units(_files(spark, d), CFG)


_scans: dict[tuple, tuple[list, ScanResult]] = {}


def _state(spark, d) -> list[tuple]:
    """Path, size and time of change of each file of the tables that an analysis reads."""
    out = []
    for table in ("documents", "labels"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def _scan(spark, d) -> ScanResult:
    """One analysis for each session, folder and state of its files; later queries are lookups in its written result."""
    key, state = (spark.sparkContext.applicationId, d), _state(spark, d)
    if key not in _scans or _scans[key][0] != state:
        _scans[key] = state, analyze(_files(spark, d), _units(spark, d), CFG)
    return _scans[key][1]


# files ------------------------------------------------------------------------------------------------------------


@query("SELECT lang AS language, source AS dir, count(*) AS files, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY ALL")
def file_inventory(spark, d):
    return _docs(spark, d).groupBy(F.col("lang").alias("language"), F.col("source").alias("dir")).agg(F.count("*").alias("files"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))


@query("SELECT lang AS language, count(*) AS files FROM documents GROUP BY lang")
def language_counts(spark, d):
    return _docs(spark, d).groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"))


@query("SELECT doc_id, strlen(text)::BIGINT AS size FROM documents WHERE strlen(text) <= 4096")
def size_filter(spark, d):
    return S.within_size(_docs(spark, d), "text", 4096).select("doc_id", F.octet_length("text").cast("long").alias("size"))


@query("SELECT doc_id, strlen(text) >= 500 AND strlen(text) // greatest(length(text) - length(replace(text, chr(10), '')), 1) > 200 AS minified FROM documents")
def minified_filter(spark, d):
    return _docs(spark, d).select("doc_id", S.is_minified(F.col("text")).alias("minified"))


@query("SELECT doc_id, list_bool_or(list_transform(['DO NOT EDIT', 'auto-generated', 'Auto-generated', 'Generated by', '@generated'], lambda m: regexp_matches(substr(hex(encode(text)), 1, 4096), '^(?:..)*' || hex(encode(m))))) AS generated FROM documents")
def generated_filter(spark, d):
    return _docs(spark, d).select("doc_id", S.is_generated(F.col("text")).alias("generated"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1)"


def _paths(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/?(.*)$", 1).alias("path"))


@query(f"SELECT page_id, {_PATH} AS path, regexp_matches({_PATH}, '^[^/]*/1[^/]*$') OR regexp_matches(regexp_extract({_PATH}, '([^/]*)$', 1), '^[^/]*5$') AS excluded FROM pages")
def exclude_globs(spark, d):
    return _paths(spark, d).withColumn("excluded", S.matches_any(F.col("path"), ["*/1*", "**/*5"]))


@query(f"SELECT page_id, {_PATH} AS path, len(list_intersect(string_split({_PATH}, '/')[:-2], ['vendor', 'node_modules', '__pycache__', '.git', '.kindred', '.bundle', '.next', 'dist', 'build', 'tmp', 'log', 'coverage'])) > 0 AS pruned FROM pages")
def directory_pruning(spark, d):
    return _paths(spark, d).withColumn("pruned", S.is_pruned(F.col("path"), CFG))


@query(f"SELECT page_id, CASE lower(regexp_extract({_PATH}, '([.][^./]*)$', 1)) WHEN '.go' THEN 'go' WHEN '.rb' THEN 'ruby' WHEN '.rake' THEN 'ruby' WHEN '.gemspec' THEN 'ruby' WHEN '.m' THEN 'objc' WHEN '.mm' THEN 'objc' WHEN '.cs' THEN 'csharp' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'javascript' WHEN '.tsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.mts' THEN 'javascript' END AS language FROM pages")
def language_lookup(spark, d):
    return _paths(spark, d).select("page_id", S.language_of(F.col("path")).alias("language"))


@query(f"SELECT page_id, coalesce(CASE WHEN {_PATH} = '' THEN '.' WHEN contains({_PATH}, '/') THEN regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) ELSE '.' END, '.') AS dir, regexp_extract({_PATH}, '([^/]*)$', 1) AS base FROM pages")
def path_parts(spark, d):
    return _paths(spark, d).select("page_id", T.directory(F.col("path")).alias("dir"), T.base_name(F.col("path")).alias("base"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS region, len(string_split(text, chr(10)))::INT AS n_lines FROM documents")
def compare_regions(spark, d):
    return _docs(spark, d).select("doc_id", S.region_text(F.col("text"), 2, 3).alias("region"), F.size(F.split("text", "\n")).alias("n_lines"))


# tokens and statements ----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {oracle.tokens('text')} AS t FROM documents)")
def tokenize(spark, d):
    t = _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, len(list_filter(t, lambda x: x = '$INT'))::INT AS ints, len(list_filter(t, lambda x: x = '$FLOAT'))::INT AS floats, len(list_filter(t, lambda x: x = '$STR'))::INT AS strings, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {oracle.light(oracle.tokens('text'))} AS t FROM documents)")
def normalize_light(spark, d):
    t = _docs(spark, d).select("doc_id", F.transform(T.tokens(F.col("text")), T.light).alias("t"))
    n = lambda k: F.size(F.filter("t", lambda x: x == k))
    return t.select("doc_id", n("$INT").alias("ints"), n("$FLOAT").alias("floats"), n("$STR").alias("strings"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    f"""WITH p AS (SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS tok FROM (SELECT doc_id, {oracle.light(oracle.tokens('text'))} AS t FROM documents)),
f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, tok) AS first FROM p),
r AS (SELECT doc_id, pos, CASE WHEN starts_with(tok, '$') THEN tok ELSE '$V' || (dense_rank() OVER (PARTITION BY doc_id, starts_with(tok, '$') ORDER BY first) - 1) END AS norm FROM f)
SELECT doc_id, count(*) AS n_tokens, count(DISTINCT norm) AS n_names, md5(string_agg(norm, ' ' ORDER BY pos)) AS digest FROM r GROUP BY doc_id"""
)
def normalize_strong(spark, d):
    from kindred.operators.normalize import positional_names

    t = _docs(spark, d).select("doc_id", F.posexplode(F.transform(T.tokens(F.col("text")), T.light)).alias("pos", "tok"))
    named = positional_names(t, "doc_id", keep=F.startswith(F.col("tok"), F.lit("$")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), " ")
    return named.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("norm").alias("n_names"), F.md5(text).alias("digest"))


@query("WITH d AS (SELECT doc_id, text, NULL AS file, NULL AS dir FROM documents), stm AS (" + oracle.STEPS["stm"] + ") SELECT doc_id, count(line)::INT AS stmt_count, coalesce(max(len(tokens)), 0)::INT AS longest FROM (SELECT doc_id FROM d) LEFT JOIN stm USING (doc_id) GROUP BY doc_id")
def stmt_count(spark, d):
    s = _docs(spark, d).select("doc_id", statements(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", F.size("s").alias("stmt_count"), F.coalesce(F.array_max(F.transform("s", lambda x: F.size(x["tokens"]))), F.lit(0)).alias("longest"))


@query(
    f"""WITH p AS (SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS tok FROM (SELECT doc_id, {oracle.tokens('text')} AS t FROM documents)),
g AS (SELECT *, coalesce(sum(CASE WHEN ends_with(tok, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stmt FROM p),
s AS (SELECT doc_id, stmt, count(*) AS n, any_value(tok) AS one FROM g GROUP BY doc_id, stmt)
SELECT doc_id, count(*) AS n_statements, max(n) AS longest FROM s WHERE NOT (n = 1 AND ends_with(one, '.')) GROUP BY doc_id"""
)
def split_statements(spark, d):
    from kindred.operators.normalize import statement_ids

    t = _docs(spark, d).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "tok"))
    s = statement_ids(t, "doc_id", F.endswith(F.col("tok"), F.lit("."))).groupBy("doc_id", "stmt").agg(F.count("*").alias("n"), F.max("tok").alias("one"))
    return s.where(~((F.col("n") == 1) & F.endswith(F.col("one"), F.lit(".")))).groupBy("doc_id").agg(F.count("*").alias("n_statements"), F.max("n").alias("longest"))


@query(oracle.sql("units", "SELECT unit_idx, start_line::INT AS start_line, end_line::INT AS end_line, n_tokens::INT AS n_tokens FROM units WHERE kind = 'window'"))
def statement_windows(spark, d):
    return _units(spark, d).where("kind = 'window'").select("unit_idx", "start_line", "end_line", "n_tokens")


@query(
    """WITH c AS (SELECT page_id, pos, CASE WHEN ch = '<' THEN 1 ELSE -1 END AS step FROM (SELECT page_id, generate_subscripts(l, 1) AS pos, unnest(l) AS ch FROM (SELECT page_id, regexp_extract_all(html, '[<>]') AS l FROM pages))),
x AS (SELECT page_id, pos, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM c)
SELECT page_id, max(depth)::BIGINT AS deepest, arg_max(depth, pos)::BIGINT AS at_end, min(pos) FILTER (depth = 0)::BIGINT AS first_closed FROM x GROUP BY page_id"""
)
def bracket_depth(spark, d):
    from kindred.operators.normalize import bracket_depths

    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("[<>]"), 0)).alias("pos", "tok"))
    x = bracket_depths(p, "page_id", "<", ">")
    return x.groupBy("page_id").agg(F.max("depth").alias("deepest"), F.max_by("depth", "pos").alias("at_end"), F.min(F.when(F.col("depth") == 0, F.col("pos") + 1)).cast("long").alias("first_closed"))


@query(oracle.sql("units", "SELECT unit_idx, kind, token_hash FROM units"))
def token_hash(spark, d):
    return _units(spark, d).select("unit_idx", "kind", "token_hash")


@query(oracle.sql("units", "SELECT unit_idx, sha256(array_to_string(tokens, ' ')) AS form_hash, length(array_to_string(tokens, ' '))::INT AS chars FROM units WHERE kind = 'function'"))
def norm_form(spark, d):
    u = _units(spark, d).where("kind = 'function'")
    return u.select("unit_idx", F.sha2(F.array_join("tokens", " "), 256).alias("form_hash"), F.length(F.array_join("tokens", " ")).alias("chars"))


# matching -------------------------------------------------------------------------------------------------------------


@query("SELECT token_hash, count(*) AS members, min(doc_id) AS first_unit FROM (SELECT doc_id, sha256(array_to_string(" + oracle.tokens("text") + ", ' ')) AS token_hash FROM documents) GROUP BY token_hash HAVING count(*) >= 2")
def exact_classes(spark, d):
    h = _docs(spark, d).select("doc_id", T.token_hash(T.tokens(F.col("text"))).alias("token_hash"))
    return h.groupBy("token_hash").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_unit")).where("members >= 2")


@query(f"SELECT token_hash, count(*) AS members, count(DISTINCT origin) AS origins FROM (SELECT 'documents' AS origin, sha256(array_to_string({oracle.tokens('text')}, ' ')) AS token_hash FROM documents UNION ALL SELECT 'conversations', sha256(array_to_string({oracle.tokens('text')}, ' ')) FROM conversations UNION ALL SELECT 'benchmark', sha256(array_to_string({oracle.tokens('text')}, ' ')) FROM benchmark) GROUP BY token_hash HAVING count(*) >= 2")
def cross_source_classes(spark, d):
    parts = [spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(t).alias("origin"), T.token_hash(T.tokens(F.col("text"))).alias("token_hash")) for t in ("documents", "conversations", "benchmark")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("token_hash").agg(F.count("*").alias("members"), F.countDistinct("origin").alias("origins")).where("members >= 2")


@query(oracle.sql("exact", "SELECT class_id, unit_idx FROM exact"))
def dedup_overlap(spark, d):
    return match.exact_members(_units(spark, d))


@query(oracle.sql("lone", "SELECT unit_idx, kind FROM lone"))
def unmatched_units(spark, d):
    u = _units(spark, d)
    return match.unmatched(u, match.exact_members(u)).select("unit_idx", "kind")


def _shingled(spark, d) -> DataFrame:
    """Written tables, since units and shingles are read more than once."""
    scratch = Scratch(spark, "shingled")
    u = scratch.write(_units(spark, d), "units")
    return scratch.write(match.with_shingles(match.unmatched(u, scratch.write(match.exact_members(u), "exact")), CFG), "shingles")


@query(oracle.sql("sh", "SELECT unit_idx, len(shingles)::INT AS n_shingles, list_min(shingles) AS least, list_max(shingles) AS most FROM sh"))
def shingles(spark, d):
    return _shingled(spark, d).select("unit_idx", F.size("shingles").alias("n_shingles"), F.array_min("shingles").alias("least"), F.array_max("shingles").alias("most"))


@query(oracle.sql("sig", "SELECT unit_idx, md5(array_to_string(sig, ',')) AS digest, sig[1] AS first, sig[128] AS last FROM sig"))
def minhash_signature(spark, d):
    s = match.signatures(_shingled(spark, d).select("unit_idx", "shingles"), CFG.hashes)
    return s.select("unit_idx", F.md5(F.array_join("sig", ",")).alias("digest"), F.col("sig")[0].alias("first"), F.col("sig")[127].alias("last"))


@query(oracle.sql("bands", "SELECT band::INT AS band, count(DISTINCT bucket) AS buckets, count(*) AS n, max(n_in) AS largest FROM (SELECT band, bucket, count(*) OVER (PARTITION BY band, bucket) AS n_in FROM bands) GROUP BY band"))
def lsh_bands(spark, d):
    b = match.bands(_shingled(spark, d), CFG).groupBy("band", "bucket").agg(F.count("*").alias("n_in"))
    return b.groupBy("band").agg(F.count("*").alias("buckets"), F.sum("n_in").alias("n"), F.max("n_in").alias("largest"))


@query(oracle.sql("cand", "SELECT a, b FROM cand"))
def lsh_candidates(spark, d):
    return match.candidates(match.bands(_shingled(spark, d), CFG))


@query(oracle.sql("cand", "SELECT c.a, c.b, len(list_filter(range(1, 129), lambda i: x.sig[i] = y.sig[i])) / 128.0::DOUBLE AS estimate FROM cand c JOIN sig x ON x.unit_idx = a JOIN sig y ON y.unit_idx = b"))
def jaccard_estimate(spark, d):
    s = _shingled(spark, d)
    signed = match.signatures(s.select("unit_idx", "shingles"), CFG.hashes).select("unit_idx", "sig")
    c = match.candidates(match.bands(s, CFG)).join(signed.toDF("a", "x"), "a").join(signed.toDF("b", "y"), "b")
    return c.select("a", "b", T.agreement(F.col("x"), F.col("y")).alias("estimate"))


@query(oracle.sql("bands", "SELECT DISTINCT a.unit_idx AS a, b.unit_idx AS b FROM bands a JOIN bands b ON a.band = b.band AND a.bucket = b.bucket AND a.unit_idx < b.unit_idx WHERE a.file = b.file AND a.start_line <= b.end_line AND b.start_line <= a.end_line"))
def overlap_exclusion(spark, d):
    b = match.bands(_shingled(spark, d), CFG)
    x, y = b.alias("x"), b.alias("y")
    pairs = x.join(y, F.expr("x.band = y.band and x.bucket = y.bucket and x.unit_idx < y.unit_idx and x.file = y.file and x.start_line <= y.end_line and y.start_line <= x.end_line"))
    return pairs.select(F.col("x.unit_idx").alias("a"), F.col("y.unit_idx").alias("b")).distinct()


@query(oracle.sql("pairs", "SELECT a, b, round(similarity, 9) AS similarity FROM pairs"))
def verified_pairs(spark, d):
    s = _shingled(spark, d)
    return match.verified(match.candidates(match.bands(s, CFG), CFG.similarity), s, CFG.similarity).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(
    f"""WITH s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(t) - 5), lambda i: ('0x' || substr(md5(array_to_string(t[i:i + 6], ' ')), 1, 15))::BIGINT))) AS h FROM (SELECT doc_id, {oracle.tokens('text')} AS t FROM documents) WHERE len(t) >= 7),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, inter, round(inter / (x.n + y.n - inter)::DOUBLE, 9) AS similarity FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE inter / (x.n + y.n - inter)::DOUBLE >= 0.6"""
)
def shingle_jaccard_pairs(spark, d):
    return similar_pairs(_docs(spark, d), 7, 60, 100).withColumn("similarity", F.round("similarity", 9))


@query(oracle.sql("comp", "SELECT node, component FROM comp"))
def components(spark, d):
    s = _shingled(spark, d)
    return connected_components(match.verified(match.candidates(match.bands(s, CFG), CFG.similarity), s, CFG.similarity))


@query(oracle.sql("near", "SELECT class_id, count(*) AS members, any_value(similarity) AS similarity FROM near GROUP BY class_id"))
def component_similarity(spark, d):
    s = _shingled(spark, d)
    classes, members = match.near_classes(match.verified(match.candidates(match.bands(s, CFG), CFG.similarity), s, CFG.similarity), s)
    return members.groupBy("class_id").agg(F.count("*").alias("members")).join(classes, "class_id")


# findings -------------------------------------------------------------------------------------------------------------

_BY_CLASS = "n_regions", "n_functions", "n_windows", "total_tokens", "total_lines", "total_stmts"


@query(oracle.sql("totals", f"SELECT class_id, {', '.join(_BY_CLASS)}, shared_tokens::INT AS shared_tokens FROM totals"))
def class_totals(spark, d):
    return _scan(spark, d).findings.select("class_id", *_BY_CLASS, "shared_tokens")


@query(oracle.sql("totals", "SELECT class_id, kind FROM totals"))
def dominant_kind(spark, d):
    return _scan(spark, d).findings.select("class_id", "kind")


@query(oracle.sql("totals", "SELECT class_id, all_test, all_generated FROM totals"))
def all_flags(spark, d):
    return _scan(spark, d).findings.select("class_id", "all_test", "all_generated")


@query(oracle.sql("totals", "SELECT class_id, n_dirs, n_places FROM totals"))
def dir_spread(spark, d):
    return _scan(spark, d).findings.select("class_id", "n_dirs", "n_places")


def _rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(oracle.sql("parts", "SELECT class_id, type, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("confidence", "similarity", "impact", "refactorability", "repetition")) + " FROM parts"))
def score_components(spark, d):
    return _scan(spark, d).findings.select("class_id", "type", *_rounded("confidence", "similarity", "impact", "refactorability", "repetition"))


@query(oracle.sql("pen", "SELECT class_id, array_to_string(list_filter(list_transform(['all regions in test files', 'all regions in generated files', 'small region', 'only 2 members', 'low token count', 'same-function window repetition'], lambda x, i: CASE WHEN p[i] THEN x END), lambda x: x IS NOT NULL), ',') AS penalties FROM pen"))
def score_penalties(spark, d):
    return _scan(spark, d).findings.select("class_id", F.array_join(F.transform("penalties", lambda p: p["reason"]), ",").alias("penalties"))


@query(oracle.sql("scored", "SELECT class_id, round(composite, 6) AS composite, composite < 0.15 AS low FROM scored"))
def composite_score(spark, d):
    return _scan(spark, d).findings.select("class_id", *_rounded("composite"), (F.col("composite") < CFG.min_score).alias("low"))


@query(oracle.sql("parts", "SELECT class_id, CASE WHEN similarity >= 1 AND n_regions >= 3 THEN CASE WHEN n_dirs > 1 THEN 'extract_helper' ELSE 'table_driven' END WHEN similarity >= 0.8 THEN 'extract_helper' ELSE 'interface_extract' END AS category, CASE WHEN similarity >= 1 AND n_regions >= 3 THEN CASE WHEN n_dirs > 1 THEN 0.85 ELSE 0.8 END WHEN similarity >= 1 THEN 0.75 WHEN similarity >= 0.8 THEN 0.6 ELSE 0.45 END::DOUBLE AS confidence FROM parts"))
def refactor_hints(spark, d):
    return _scan(spark, d).findings.select("class_id", F.col("hint.category").alias("category"), F.col("hint.confidence").alias("confidence"))


@query(oracle.sql("merged", "SELECT class_id, finding_id, suppressed, suppress_reason FROM merged"))
def merge_findings(spark, d):
    return _scan(spark, d).findings.select("class_id", "finding_id", "suppressed", "suppress_reason")


@query(oracle.sql("scored", "SELECT class_id, 'CC-' || substr(finding_id, 1, 10) AS clone_class_id FROM scored"))
def finding_ids(spark, d):
    return _scan(spark, d).findings.select("class_id", "clone_class_id")


@query(oracle.sql("sub", "SELECT class_id FROM sub WHERE subsumed"))
def subsumed_windows(spark, d):
    return _scan(spark, d).findings.where("suppress_reason = 'window subsumed by function-level finding'").select("class_id")


@query(oracle.sql("final", "SELECT rank::INT AS rank, finding_id, suppressed FROM (SELECT *, sum(CASE WHEN suppressed THEN 0 ELSE 1 END) OVER (ORDER BY rank) AS shown FROM final) WHERE shown <= 10"))
def top_findings(spark, d):
    return score.capped(score.ranked(_scan(spark, d).findings), 10).select("rank", "finding_id", "suppressed")


@query(oracle.sql("final", "SELECT 'F-' || substr(finding_id, 1, 10) AS id, round(composite, 6) AS composite FROM final WHERE NOT suppressed AND composite >= 0.3 ORDER BY rank LIMIT 20 OFFSET 5"))
def page_findings(spark, d):
    return Session(_scan(spark, d)).list_findings(min_score=0.3, offset=5, limit=20).select("id", *_rounded("composite"))


@query(oracle.sql("final", "SELECT finding_id, type, kind, list_transform(regions, lambda r: r.file || ':' || r.a || '-' || r.b) AS places FROM final WHERE NOT suppressed ORDER BY rank LIMIT 1"))
def explain_finding(spark, d):
    s = Session(_scan(spark, d))
    first = s.list_findings(limit=1).first()
    at = F.array_sort(F.transform("regions", lambda r: F.struct(r["file"].alias("f"), r["start_line"].alias("a"), r["end_line"].alias("b"))))
    places = F.transform(at, lambda r: F.concat(r["f"], F.lit(":"), r["a"].cast("string"), F.lit("-"), r["b"].cast("string")))
    return s.explain(first.id if first else "").select("finding_id", "type", "kind", places.alias("places"))


@query(oracle.sql("merged", "SELECT CASE WHEN composite > 0.8 THEN 'High' WHEN composite > 0.5 THEN 'Medium' ELSE 'Low' END AS grade, count(*) AS findings FROM merged WHERE NOT suppressed GROUP BY grade"))
def score_histogram(spark, d):
    return Session(_scan(spark, d)).histogram()


@query(oracle.sql("merged", "SELECT (SELECT count(*) FROM d) AS files, (SELECT count(*) FROM units) AS units, (SELECT count(*) FROM units WHERE kind = 'function') AS functions, count(*) AS findings, count(*) FILTER (NOT suppressed) AS visible FROM merged"))
def run_summary(spark, d):
    return _scan(spark, d).summary()


@query("SELECT left(min(url), list_max(list_filter(range(0, length(min(url)) + 1), lambda i: left(min(url), i) = left(max(url), i)))) AS prefix FROM pages")
def common_prefix(spark, d):
    from kindred.plans.session import common_prefix as of

    return of(spark.read.parquet(f"{d}/pages.parquet"), "url")


@query(
    "WITH d AS (SELECT (CASE WHEN instr(url, '/') > 0 THEN regexp_extract(url, '^(.*)/[^/]*$', 1) ELSE '.' END) || '/' AS d FROM pages), e AS (SELECT min(d) AS a, max(d) AS b FROM d), "
    "n AS (SELECT a, b, list_max(list_filter(range(0, length(a) + 1), lambda i: left(a, i) = left(b, i) AND (i = 0 OR right(left(a, i), 1) = '/'))) AS n FROM e) "
    "SELECT CASE WHEN left(a, n) = './' THEN '' ELSE coalesce(left(a, n), '') END AS directory FROM n"
)
def common_directory(spark, d):
    from kindred.plans.session import common_directory as of

    return of(spark.read.parquet(f"{d}/pages.parquet"), "url")


@query(
    r"""SELECT file, func_name, receiver, kind, start_line::INT AS start_line, end_line::INT AS end_line, stmt_count::INT AS stmt_count, len(string_split(form, ' '))::INT AS n_tokens, form, sha256(form) AS token_hash FROM (VALUES
  ('Store.cs', 'Sum', '', 'function', 2, 9, 6, '{ var $V0 = $NUM ; foreach ( var $V1 in $V2 ) { $V0 += $V1 ; } $V3 ( $STR , $V0 ) ; return $V0 ; }'),
  ('Store.m', 'sum', '', 'function', 2, 9, 6, '{ int $V0 = $NUM ; for ( NSNumber * $V1 in $V2 ) { $V0 += [ $V1 $V3 ] ; } NSLog ( $STR , $V0 ) ; return $V0 ; }'),
  ('load.js', 'load', '', 'function', 1, 8, 6, '{ const $V0 = $STR ; const $V1 = await $V2 ( $V0 ) ; if ( ! $V1 . $V3 ) { throw new Error ( $STR ) ; } return $V1 . $V4 ( ) ; }'),
  ('shop.go', 'Total', '*Shop', 'function', 4, 17, 4, '( $R * Shop ) func $FUNC ( $P0 [ ] Item , $P1 float64 ) ( $RET0 float64 , $RET1 error ) { for $V0 , $V1 := range $P0 { if $V1 . Stock == $INT { continue } $RET0 += $V1 . Price * $P1 $R . seen [ $V0 ] = true } $V2 . Printf ( $STR , $V3 ( $P0 ) ) if $RET0 < $INT { return $INT , $V4 . New ( $STR ) } return $RET0 , nil }'),
  ('store.rb', 'find', 'self', 'function', 2, 9, 4, '( $V0 , $V1 ) $V2 = $V3 ( $STR , $V0 ) return [ ] if $V2 . $V4 $V2 . $V5 do | $V6 | $V6 . $V7 ( $V1 ) end $V2 . $V8')
) t(file, func_name, receiver, kind, start_line, end_line, stmt_count, form)"""
)
def source_functions(spark, d):
    """Normalized functions of small sources in each language; the tables play no part, the results are worked by hand."""
    from kindred.sources.code import code_units
    from kindred.sources.examples import example_files

    units = code_units(example_files(spark), Config())
    return units.select("file", "func_name", "receiver", "kind", "start_line", "end_line", "stmt_count", "n_tokens", F.array_join("tokens", " ").alias("form"), "token_hash")
