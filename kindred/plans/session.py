"""Questions about a finished scan: lists, explanations, histograms, prefixes. They read its written tables only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators import score
from kindred.plans.engine import ScanResult


class Session:
    def __init__(self, result: ScanResult):
        self.result = result
        self.findings = result.findings.withColumn("id", F.concat(F.lit("F-"), F.substring("finding_id", 1, 10)))

    def list_findings(self, min_score: float = 0.0, offset: int = 0, limit: int = 20) -> DataFrame:
        """A page of the visible findings, best first. limit: 0 for all."""
        shown = self.findings.where(~F.col("suppressed") & (F.col("composite") >= min_score))
        page = shown.orderBy(F.desc("composite"), "finding_id").offset(offset)
        return page.limit(limit) if limit else page

    def remaining(self, min_score: float = 0.0, offset: int = 0, limit: int = 20) -> int:
        """How many visible findings come after the page."""
        n = self.findings.where(~F.col("suppressed") & (F.col("composite") >= min_score)).count()
        return max(0, n - offset - limit)

    def explain(self, finding: str) -> DataFrame:
        """The finding of that short or full id."""
        return self.findings.where((F.col("id") == finding) | (F.col("finding_id") == finding)).orderBy("finding_id").limit(1)

    def normal_form(self, finding: str, most: int = 200) -> DataFrame:
        """The normalized form of the finding's first unit, cut to `most` characters; 0: whole."""
        first = self.explain(finding).select(F.array_min(F.transform("regions", lambda r: r["unit_idx"])).alias("unit_idx"))
        form = first.join(self.result.units, "unit_idx").select(T.rendered(F.col("tokens")).alias("form"))
        return form.select(F.substring("form", 1, most).alias("form")) if most else form

    def compare(self, finding: str) -> DataFrame:
        """The text of each region of a finding, from the files of the scan alone."""
        regions = self.explain(finding).select(F.explode("regions").alias("r")).select("r.*")
        lines = F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
        return regions.join(self.result.files, "file").select("file", "start_line", "end_line", F.array_join(lines, "\n").alias("text"))

    def histogram(self) -> DataFrame:
        grade = F.when(F.col("composite") > 0.8, "High").when(F.col("composite") > 0.5, "Medium").otherwise("Low")
        return self.findings.where("not suppressed").groupBy(grade.alias("grade")).agg(F.count("*").alias("findings"))

    def top(self, most: int) -> DataFrame:
        return score.capped(score.ranked(self.findings), most)


def common_prefix(paths: DataFrame, column: str) -> DataFrame:
    """The longest common beginning of all values: that of the smallest and the largest."""
    ends = paths.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    size = F.array_max(F.filter(F.sequence(F.lit(0), F.length("a")), lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)))
    return ends.select(F.substring("a", F.lit(1), size).alias("prefix"))


def common_directory(paths: DataFrame, column: str) -> DataFrame:
    """The longest directory that all paths are below, with a slash at its end; empty if there is none.

    Directories are compared by their components. What all sorted values share, the smallest and the largest share.
    """
    ends = paths.select(F.concat(T.directory(F.col(column)), F.lit("/")).alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    parts = ends.withColumns({"x": F.split("a", "/"), "y": F.split("b", "/")})
    differ = F.array_position(F.zip_with("x", "y", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    same = F.when(differ > 0, F.array_join(F.transform(F.slice("x", F.lit(1), (differ - 1).cast("int")), lambda p: F.concat(p, F.lit("/"))), "")).otherwise(F.col("a"))
    return parts.select(F.when(same == "./", "").otherwise(F.coalesce(same, F.lit(""))).alias("directory"))


def stripped(path: Column, prefix: str) -> Column:
    """The path without the prefix, if it begins with it."""
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
