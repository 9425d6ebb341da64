"""DuckDB SQL with the same results as the queries, built from the steps that they share."""

from __future__ import annotations

from kindred.functions.text import PRIME

_TOKENS = "list_filter(string_split_regex(lower({}), '[ \\t\\n\\r]+'), lambda t: t <> '')"
_LIGHT = "list_transform({}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '$INT' WHEN regexp_full_match(t, '[0-9]+[.][0-9]+') THEN '$FLOAT' WHEN regexp_full_match(t, '\".*\"') THEN '$STR' ELSE t END)"

#: Name, and the SQL of a step that reads those before it.
STEPS = {
    "d": "SELECT doc_id, coalesce(text, '') AS text, source || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.' || lang AS file, source AS dir, lang FROM documents",
    "stm": f"SELECT doc_id, file, dir, line, n_lines, {_LIGHT.format(_TOKENS.format('s'))} AS tokens FROM (SELECT doc_id, file, dir, generate_subscripts(l, 1) AS line, unnest(l) AS s, len(l) AS n_lines FROM (SELECT doc_id, file, dir, string_split(text, chr(10)) AS l FROM d)) WHERE len({_TOKENS.format('s')}) > 0",
    "num": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM stm",
    "wins": "SELECT * FROM (SELECT doc_id, file, dir, k, n, n_lines, line AS start_line, lead(line, 4) OVER w AS end_line, flatten([tokens, lead(tokens, 1) OVER w, lead(tokens, 2) OVER w, lead(tokens, 3) OVER w, lead(tokens, 4) OVER w]) AS tokens FROM num WINDOW w AS (PARTITION BY doc_id ORDER BY line)) WHERE n >= 8 AND n_lines >= 6 AND k <= n - 4",
    "units": """SELECT *, len(tokens) AS n_tokens, sha256(array_to_string(tokens, ' ')) AS token_hash FROM (
  SELECT doc_id * 1048576 AS unit_idx, doc_id, file, dir, 'function' AS kind, 1 AS start_line, max(n_lines) AS end_line, max(n) AS stmt_count, flatten(list(tokens ORDER BY line)) AS tokens FROM num WHERE n >= 3 AND n_lines >= 6 GROUP BY doc_id, file, dir
  UNION ALL SELECT doc_id * 1048576 + k, doc_id, file, dir, 'window', start_line, end_line, 5, tokens FROM wins WHERE len(tokens) >= 5)""",
    "pos": "SELECT token_hash || file AS g, token_hash, unit_idx, start_line, end_line, row_number() OVER (PARTITION BY token_hash, file ORDER BY start_line, unit_idx) AS rn, count(*) OVER (PARTITION BY token_hash, file) AS size FROM units",
    "fold": """SELECT g, token_hash, rn, size, unit_idx AS u, start_line AS s, end_line AS e, NULL::BIGINT AS done FROM pos WHERE rn = 1 UNION ALL
  SELECT f.g, f.token_hash, x.rn, f.size, CASE WHEN x.start_line > f.e OR x.end_line - x.start_line > f.e - f.s THEN x.unit_idx ELSE f.u END,
  CASE WHEN x.start_line > f.e OR x.end_line - x.start_line > f.e - f.s THEN x.start_line ELSE f.s END,
  CASE WHEN x.start_line > f.e OR x.end_line - x.start_line > f.e - f.s THEN x.end_line ELSE f.e END,
  CASE WHEN x.start_line > f.e THEN f.u END FROM fold f JOIN pos x ON x.g = f.g AND x.rn = f.rn + 1""",
    "kept": "SELECT token_hash, done AS unit_idx FROM fold WHERE done IS NOT NULL UNION ALL SELECT token_hash, u FROM fold WHERE rn = size",
    "exact": "SELECT class_id, unit_idx FROM (SELECT unit_idx, min(unit_idx) OVER w AS class_id, count(*) OVER w AS n FROM kept WINDOW w AS (PARTITION BY token_hash)) WHERE n >= 2",
    "lone": "SELECT * FROM units WHERE unit_idx NOT IN (SELECT unit_idx FROM exact)",
    "sh": "SELECT * FROM (SELECT unit_idx, doc_id, file, dir, kind, start_line, end_line, stmt_count, n_tokens, list_distinct(list_transform(range(1, len(tokens) - 5), lambda i: ('0x' || substr(md5(array_to_string(tokens[i:i + 6], ' ')), 1, 15))::BIGINT)) AS shingles FROM lone WHERE len(tokens) >= 7)",
    "sig": f"SELECT unit_idx, file, start_line, end_line, list_transform(range(0, 128), lambda i: list_min(list_transform(shingles, lambda s: (((i * 1103515245 + 12345) % {PRIME} + 1) * (s % {PRIME}) + (i * 4770526761 + 362437) % {PRIME}) % {PRIME}))) AS sig FROM sh",
    "bands": "SELECT unit_idx, file, start_line, end_line, b AS band, array_to_string(sig[b * 8 + 1:b * 8 + 8], ',') AS bucket FROM sig, (SELECT unnest(range(0, 16)) AS b)",
    "cand": "SELECT DISTINCT a.unit_idx AS a, b.unit_idx AS b FROM bands a JOIN bands b ON a.band = b.band AND a.bucket = b.bucket AND a.unit_idx < b.unit_idx WHERE NOT (a.file = b.file AND a.start_line <= b.end_line AND b.start_line <= a.end_line)",
    "pairs": "SELECT * FROM (SELECT a, b, len(list_intersect(x.shingles, y.shingles)) / (len(x.shingles) + len(y.shingles) - len(list_intersect(x.shingles, y.shingles)))::DOUBLE AS similarity FROM cand JOIN sh x ON x.unit_idx = a JOIN sh y ON y.unit_idx = b) WHERE similarity >= 0.6",
    "sym": "SELECT a, b FROM pairs UNION SELECT b, a FROM pairs",
    "reach": "SELECT a AS node, a AS r FROM sym UNION SELECT e.b, c.r FROM reach c JOIN sym e ON e.a = c.node",
    "comp": "SELECT node, min(r) AS component FROM reach GROUP BY node",
    "mean": "SELECT component, least(round(avg(similarity), 9), 1.0) AS similarity FROM pairs JOIN comp ON a = node GROUP BY component",
    "npos": "SELECT component || ':' || file AS g, component, unit_idx, start_line, end_line, row_number() OVER (PARTITION BY component, file ORDER BY start_line, unit_idx) AS rn, count(*) OVER (PARTITION BY component, file) AS size FROM comp JOIN sh ON node = unit_idx",
    "nfold": """SELECT g, component, rn, size, unit_idx AS u, start_line AS s, end_line AS e, NULL::BIGINT AS done FROM npos WHERE rn = 1 UNION ALL
  SELECT f.g, f.component, x.rn, f.size, CASE WHEN x.start_line > f.e OR x.end_line - x.start_line > f.e - f.s THEN x.unit_idx ELSE f.u END,
  CASE WHEN x.start_line > f.e OR x.end_line - x.start_line > f.e - f.s THEN x.start_line ELSE f.s END,
  CASE WHEN x.start_line > f.e OR x.end_line - x.start_line > f.e - f.s THEN x.end_line ELSE f.e END,
  CASE WHEN x.start_line > f.e THEN f.u END FROM nfold f JOIN npos x ON x.g = f.g AND x.rn = f.rn + 1""",
    "nkept": "SELECT component, done AS unit_idx FROM nfold WHERE done IS NOT NULL UNION ALL SELECT component, u FROM nfold WHERE rn = size",
    "near": "SELECT class_id, unit_idx, similarity FROM (SELECT component, unit_idx, min(unit_idx) OVER w AS class_id, count(*) OVER w AS n FROM nkept WINDOW w AS (PARTITION BY component)) JOIN mean USING (component) WHERE n >= 2",
    "members": "SELECT class_id, unit_idx, 'exact' AS type, 'exact_hash' AS metric, 1.0::DOUBLE AS similarity FROM exact UNION ALL SELECT class_id, unit_idx, 'near_duplicate', 'minhash_lsh', similarity FROM near",
    "flags": "SELECT doc_id, max(toxic) = 1 AS is_test, min(quality) = 0 AS is_generated FROM labels GROUP BY doc_id",
    "totals": """SELECT class_id, any_value(type) AS type, any_value(metric) AS metric, any_value(similarity) AS similarity, count(*) AS n_regions,
  count(*) FILTER (kind = 'function') AS n_functions, count(*) FILTER (kind = 'window') AS n_windows, sum(n_tokens)::BIGINT AS total_tokens, sum(end_line - start_line + 1)::BIGINT AS total_lines,
  sum(stmt_count)::BIGINT AS total_stmts, count(DISTINCT dir) AS n_dirs, count(DISTINCT file) AS n_places, bool_and(coalesce(is_test, false)) AS all_test, bool_and(coalesce(is_generated, false)) AS all_generated,
  arg_min(n_tokens, unit_idx) AS shared_tokens, CASE WHEN count(*) FILTER (kind = 'function') >= count(*) FILTER (kind = 'window') THEN 'function' ELSE 'window' END AS kind,
  list({'file': file, 'a': start_line, 'b': end_line} ORDER BY file, start_line, end_line) AS regions
  FROM members JOIN units USING (unit_idx) LEFT JOIN flags USING (doc_id) GROUP BY class_id""",
    "parts": """SELECT *, CASE WHEN metric = 'exact_hash' THEN 0.95::DOUBLE WHEN similarity > 0.8 THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END AS confidence, (least(1.0::DOUBLE, n_regions / 5.0::DOUBLE) + least(1.0::DOUBLE, total_lines / 200.0::DOUBLE)) / 2 AS impact,
  least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN n_dirs = 1 THEN 0.3::DOUBLE WHEN n_dirs <= 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN similarity >= 1 THEN 0.2::DOUBLE WHEN similarity >= 0.8 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) AS refactorability, least(1.0::DOUBLE, n_regions / 10.0::DOUBLE) AS repetition FROM totals""",
    "pen": """SELECT *, [all_test, all_generated, floor(total_stmts / n_regions) < 5, n_regions = 2, floor(total_tokens / n_regions) < 25, kind = 'window' AND n_places = 1] AS p,
  least(1.0::DOUBLE, (0.1::DOUBLE * confidence + 0.3::DOUBLE * similarity + 0.25::DOUBLE * impact + 0.2::DOUBLE * refactorability + 0.15::DOUBLE * repetition) * CASE WHEN kind = 'function' THEN 1.15::DOUBLE ELSE 0.85::DOUBLE END) AS base FROM parts""",
    "scored": """SELECT *, round(base * CASE WHEN p[1] THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN p[2] THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN p[3] THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN p[4] THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN p[5] THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN p[6] THEN 0.5::DOUBLE ELSE 1 END, 9) AS composite,
  sha1(array_to_string(list_transform(regions, lambda r: r.file || ':' || r.a || ':' || r.b || chr(10)), '') || 'type:' || CASE type WHEN 'exact' THEN 0 ELSE 2 END || chr(10) || 'level:1' || chr(10)) AS finding_id FROM pen""",
    "visible": "SELECT *, composite < 0.15 AS low FROM scored",
    "region": "SELECT class_id, kind, low, unnest(regions) AS r FROM visible",
    "inside": "SELECT w.class_id, count(*) AS n_inside FROM region w WHERE w.kind = 'window' AND NOT w.low AND EXISTS (SELECT 1 FROM region f WHERE f.kind = 'function' AND NOT f.low AND f.r.file = w.r.file AND w.r.a >= f.r.a AND w.r.b <= f.r.b) GROUP BY w.class_id",
    "sub": "SELECT v.*, NOT low AND kind = 'window' AND coalesce(n_inside = n_regions, false) AS subsumed FROM visible v LEFT JOIN inside USING (class_id)",
    "signed": "SELECT *, CASE WHEN NOT low AND NOT subsumed AND kind = 'window' THEN array_to_string(list_sort(list_transform(regions, lambda r: r.file || ':body|')), '') END AS signature FROM sub",
    "placed": "SELECT *, CASE WHEN signature IS NOT NULL THEN row_number() OVER (PARTITION BY signature ORDER BY composite DESC, finding_id) END AS place FROM signed",
    "others": "SELECT signature, r.file AS file, min(r.a) AS a, max(r.b) AS b FROM (SELECT signature, class_id, unnest(list_filter(regions, lambda r, i: i = 1 OR regions[i - 1].file <> r.file)) AS r FROM placed WHERE place > 1) GROUP BY signature, r.file",
    "wide": "SELECT p.class_id, list({'file': p.r.file, 'a': least(p.r.a, o.a), 'b': greatest(p.r.b, o.b)} ORDER BY p.r.file, least(p.r.a, o.a), greatest(p.r.b, o.b)) AS regions FROM (SELECT class_id, signature, unnest(regions) AS r FROM placed WHERE place = 1) p JOIN others o ON o.signature = p.signature AND o.file = p.r.file GROUP BY p.class_id",
    "merged": """SELECT p.* EXCLUDE (regions, finding_id), coalesce(w.regions, p.regions) AS regions, low OR subsumed OR coalesce(place > 1, false) AS suppressed,
  CASE WHEN w.regions IS NULL THEN finding_id ELSE sha1(array_to_string(list_transform(w.regions, lambda r: r.file || ':' || r.a || ':' || r.b || chr(10)), '') || 'type:' || CASE type WHEN 'exact' THEN 0 ELSE 2 END || chr(10) || 'level:1' || chr(10)) END AS finding_id,
  CASE WHEN low THEN 'score below threshold' WHEN subsumed THEN 'window subsumed by function-level finding' WHEN place > 1 THEN 'merged into overlapping finding' END AS suppress_reason FROM placed p LEFT JOIN wide w USING (class_id)""",
    "final": "SELECT *, row_number() OVER (ORDER BY composite DESC, finding_id) AS rank FROM merged",
}


_RECURSIVE = {"fold", "nfold", "reach"}


def sql(last: str, select: str) -> str:
    """The steps down to `last`, and a query over them."""
    names = list(STEPS)
    used = names[: names.index(last) + 1]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({STEPS[n]})" for n in used) + f"\n{select}"


def tokens(column: str) -> str:
    return _TOKENS.format(column)


def light(column: str) -> str:
    return _LIGHT.format(column)
