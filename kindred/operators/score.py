"""Scores, penalties, hints, ids, suppression and merging of findings, as column expressions over a row per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.config import Config

# Fixed values.
TYPES = {"exact": 0, "renamed": 1, "near_duplicate": 2}
TYPE_CODES = {"exact": "EX", "renamed": "RN", "near_duplicate": "ND", "pattern": "PT"}
HINT_CODES = {"extract_helper": "EH", "generic_func": "GF", "table_driven": "TD", "shared_validator": "SV", "adapter_mapper": "AM", "interface_extract": "IE", "config_driven": "CD"}


def class_totals(members: DataFrame, units: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each class: regions, kind, totals, directories and flags."""
    flags = files.select("file", "is_test", "is_generated")
    if "root" in files.columns:  # of equal paths under several roots the last root's file counts
        last = F.max_by(F.struct("is_test", "is_generated"), "root").alias("f")
        flags = files.groupBy("file").agg(last).select("file", "f.is_test", "f.is_generated")
    rows = members.join(units, "unit_idx").join(flags, "file", "left")
    region = F.struct("file", "start_line", "end_line", "func_name", "unit_idx")
    each = rows.groupBy("class_id").agg(
        F.array_sort(F.collect_list(region)).alias("regions"),
        F.count("*").alias("n_regions"),
        F.count_if(F.col("kind") == "function").alias("n_functions"),
        F.count_if(F.col("kind") == "window").alias("n_windows"),
        F.sum("n_tokens").alias("total_tokens"),
        F.sum(F.col("end_line") - F.col("start_line") + 1).alias("total_lines"),
        F.sum("stmt_count").alias("total_stmts"),
        F.countDistinct("dir").alias("n_dirs"),
        F.countDistinct("file", "func_name").alias("n_places"),
        F.every(F.coalesce("is_test", F.lit(False))).alias("all_test"),
        F.every(F.coalesce("is_generated", F.lit(False))).alias("all_generated"),
        F.min_by("n_tokens", "unit_idx").alias("shared_tokens"),
    )
    return each.withColumn("kind", F.when(F.col("n_functions") >= F.col("n_windows"), "function").otherwise("window"))


def confidence(level: int) -> Column:
    by_level = {0: 1.0, 1: 0.95, 2: 0.85}[level]
    return F.when(F.col("metric") == "exact_hash", by_level).when(F.col("metric") == "minhash_lsh", F.when(F.col("similarity") > 0.8, 0.80).otherwise(0.65)).otherwise(0.50)


def with_scores(classes: DataFrame, cfg: Config) -> DataFrame:
    """Adds the score's parts, penalties, composite, id, hint and the suppression by score."""
    n, lines, dirs, sim = F.col("n_regions"), F.col("total_lines"), F.col("n_dirs"), F.col("similarity")
    one = F.lit(1.0)
    parts = classes.withColumns(
        {
            "confidence": confidence(cfg.level_number),
            "impact": (F.least(one, n / 5.0) + F.least(one, lines / 200.0)) / 2,
            "refactorability": F.least(one, F.lit(0.5) + F.when(dirs == 1, 0.3).when(dirs <= 3, 0.1).otherwise(0.0) + F.when(sim >= 1, 0.2).when(sim >= 0.8, 0.1).otherwise(0.0)),
            "repetition": F.least(one, n / 10.0),
        }
    )
    base = (
        cfg.weight_confidence * F.col("confidence") + cfg.weight_similarity * sim + cfg.weight_impact * F.col("impact")
        + cfg.weight_refactorability * F.col("refactorability") + cfg.weight_repetition * F.col("repetition")
    )
    base = F.least(one, base * F.when(F.col("kind") == "function", 1.15).otherwise(0.85))

    def penalty(when: Column, reason: str, factor: float) -> Column:
        return F.when(when, F.struct(F.lit(reason).alias("reason"), F.lit(factor).alias("factor")))

    penalties = F.array_compact(
        F.array(
            penalty(F.col("all_test"), "all regions in test files", cfg.test_penalty),
            penalty(F.col("all_generated"), "all regions in generated files", cfg.generated_penalty),
            penalty(F.floor(F.col("total_stmts") / n) < 5, "small region", cfg.small_penalty),
            penalty(n == 2, "only 2 members", 0.9),
            penalty(F.floor(F.col("total_tokens") / n) < 25, "low token count", 0.6),
            penalty((F.col("kind") == "window") & (n >= 2) & (F.col("n_places") == 1), "same-function window repetition", 0.5),
        )
    )
    scored = parts.withColumn("penalties", penalties).withColumn("composite", F.aggregate("penalties", base, lambda a, p: a * p["factor"]))
    scored = scored.withColumn("composite", F.round("composite", 9))
    return scored.withColumns(
        {
            "finding_id": finding_id(F.col("regions"), F.col("type"), cfg.level_number),
            "hint": hint(),
            "suppressed": F.col("composite") < cfg.min_score,
            "suppress_reason": F.when(F.col("composite") < cfg.min_score, "score below threshold"),
        }
    ).withColumn("clone_class_id", F.concat(F.lit("CC-"), F.substring("finding_id", 1, 10)))


def finding_id(regions: Column, kind: Column, level: int) -> Column:
    lines = F.transform(F.array_sort(F.transform(regions, lambda r: F.struct(r["file"].alias("file"), r["start_line"].alias("a"), r["end_line"].alias("b")))), lambda r: F.concat(r["file"], F.lit(":"), r["a"].cast("string"), F.lit(":"), r["b"].cast("string"), F.lit("\n")))
    number = F.lit(None)
    for name, i in TYPES.items():
        number = F.when(kind == name, str(i)).otherwise(number)
    return F.sha1(F.concat(F.array_join(lines, ""), F.lit("type:"), number, F.lit(f"\nlevel:{level}\n")))


def hint() -> Column:
    sim, n = F.col("similarity"), F.col("n_regions")
    of = lambda c, x: F.struct(F.lit(c).alias("category"), F.lit(x).alias("confidence"))
    return (
        F.when((sim >= 1) & (n >= 3), F.when(F.col("n_dirs") > 1, of("extract_helper", 0.85)).otherwise(of("table_driven", 0.80)))
        .when((sim >= 1) & (n == 2), of("extract_helper", 0.75))
        .when(sim >= 0.8, of("extract_helper", 0.60))
        .when(sim >= 0.6, of("interface_extract", 0.45))
    )


def suppress_subsumed(findings: DataFrame) -> DataFrame:
    """Suppresses window findings all of whose regions lie within regions of visible function findings."""
    shown = findings.where("not suppressed")
    regions = shown.select("class_id", "kind", F.explode("regions").alias("r")).select("class_id", "kind", "r.file", "r.start_line", "r.end_line")
    functions = regions.where("kind = 'function'").select("file", F.col("start_line").alias("s"), F.col("end_line").alias("e")).distinct()
    windows = regions.where("kind = 'window'")
    # a join with conditions on ranges: the file's regions are few, and each window's region is left at most once
    inside = windows.join(functions, (windows.file == functions.file) & (windows.start_line >= functions.s) & (windows.end_line <= functions.e), "left_semi")
    counts = inside.groupBy("class_id").agg(F.count("*").alias("n_inside"))
    out = findings.join(counts, "class_id", "left").withColumn("gone", ~F.col("suppressed") & (F.col("kind") == "window") & (F.col("n_inside") == F.col("n_regions")))
    return _suppressed(out, "gone", "window subsumed by function-level finding").drop("gone", "n_inside")


def _suppressed(df: DataFrame, flag: str, reason: str) -> DataFrame:
    on = F.coalesce(F.col(flag), F.lit(False))
    return df.withColumns({"suppress_reason": F.when(on, reason).otherwise(F.col("suppress_reason")), "suppressed": F.col("suppressed") | on})


def merge_windows(findings: DataFrame, cfg: Config) -> DataFrame:
    """Of visible window findings over the same functions, the best takes in the others' lines; those are suppressed."""
    signature = F.when(~F.col("suppressed") & (F.col("kind") == "window"), F.array_join(F.array_sort(F.transform("regions", lambda r: F.concat(r["file"], F.lit(":"), r["func_name"], F.lit("|")))), ""))
    best_first = Window.partitionBy("signature").orderBy(F.desc("composite"), "finding_id")
    ranked = findings.withColumn("signature", signature)
    windows = ranked.where("signature is not null").withColumn("place", F.row_number().over(best_first))
    others = windows.where("place > 1").select("signature", "class_id", F.posexplode("regions").alias("i", "r"))
    first = others.groupBy("signature", "class_id", "r.file", "r.func_name").agg(F.min_by("r.start_line", "i").alias("a"), F.min_by("r.end_line", "i").alias("b"))
    spans = first.groupBy("signature", "file", "func_name").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    best = windows.where("place = 1").select("class_id", "signature", F.posexplode("regions").alias("i", "r"))
    wide = best.join(spans, (best.signature == spans.signature) & (best.r["file"] == spans.file) & (best.r["func_name"] == spans.func_name))
    wide = wide.select("class_id", F.struct("i", F.struct(F.col("r.file").alias("file"), F.least("r.start_line", "a").alias("start_line"), F.greatest("r.end_line", "b").alias("end_line"), F.col("r.func_name").alias("func_name"), F.col("r.unit_idx").alias("unit_idx")).alias("r")).alias("x"))
    wide = wide.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("wide"))
    out = ranked.drop("signature").join(windows.select("class_id", (F.col("place") > 1).alias("merged")), "class_id", "left").join(wide, "class_id", "left")
    out = _suppressed(out, "merged", "merged into overlapping finding")
    out = out.withColumn("regions", F.coalesce("wide", "regions"))
    return out.withColumn("finding_id", F.when(F.col("wide").isNotNull(), finding_id(F.col("regions"), F.col("type"), cfg.level_number)).otherwise(F.col("finding_id"))).drop("merged", "wide")


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with rank, by composite score and id. A report's order is total, over rows that are findings, not data."""
    return findings.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "finding_id")))


def capped(findings: DataFrame, most: int) -> DataFrame:
    """Cuts the order at the visible finding after `most`; what is suppressed beyond it goes, too. 0: no limit."""
    if not most:
        return findings
    shown = F.sum((~F.col("suppressed")).cast("int")).over(Window.orderBy(F.desc("composite"), "finding_id"))
    return findings.withColumn("shown", shown).where(F.col("shown") <= most).drop("shown")
