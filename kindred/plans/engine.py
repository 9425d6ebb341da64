"""The whole analysis as one DataFrame program: units, classes, findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.operators import match, score
from kindred.plans.storage import Scratch


@dataclass
class ScanResult:
    """files, units, classes and findings of one analysis; tables that later questions read."""

    files: DataFrame
    units: DataFrame
    members: DataFrame
    findings: DataFrame
    cfg: Config

    def summary(self) -> DataFrame:
        """One row of counts."""
        units = self.units.agg(F.count("*").alias("units"), F.count_if(F.col("kind") == "function").alias("functions"))
        found = self.findings.agg(F.count("*").alias("findings"), F.count_if(~F.col("suppressed")).alias("visible"))
        return self.files.agg(F.count("*").alias("files")).crossJoin(units).crossJoin(found)


def find_classes(units: DataFrame, cfg: Config, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes (class_id, type, metric, similarity) and members (class_id, unit_idx). units is read several times."""
    exact = scratch.write(match.exact_members(units), "exact")
    left = match.unmatched(units, exact)
    shingled = scratch.write(match.with_shingles(left, cfg), "shingles")
    pairs = scratch.write(match.verified(match.candidates(match.bands(shingled, cfg), cfg.similarity), shingled, cfg.similarity), "pairs")
    near, near_members = match.near_classes(pairs, shingled)
    kind = "renamed" if cfg.level_number >= 2 else "exact"
    classes = exact.select("class_id").distinct().select("class_id", F.lit(kind).alias("type"), F.lit("exact_hash").alias("metric"), F.lit(1.0).alias("similarity"))
    classes = classes.unionByName(near.select("class_id", F.lit("near_duplicate").alias("type"), F.lit("minhash_lsh").alias("metric"), "similarity"))
    return scratch.write(classes, "classes"), scratch.write(exact.unionByName(near_members), "members")


def analyze(files: DataFrame, units: DataFrame, cfg: Config) -> ScanResult:
    """files: (file, is_test, is_generated, ...); units as of kindred.operators.units or a code front end."""
    if wrong := cfg.check():
        raise ValueError("; ".join(wrong))
    scratch = Scratch(files.sparkSession, "scan")
    units = scratch.write(units, "units")
    classes, members = find_classes(units, cfg, scratch)
    found = score.with_scores(classes.join(score.class_totals(members, units, files), "class_id"), cfg)
    found = score.merge_windows(score.suppress_subsumed(scratch.write(found, "scored")), cfg)
    found = score.capped(scratch.write(found, "merged"), cfg.max_findings)
    return ScanResult(files, units, members, scratch.write(found, "findings"), cfg)
