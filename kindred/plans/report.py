"""Reports of a scan: text for people, JSON for programs. A report is as long as its findings are many, not as the data."""

from __future__ import annotations

import json

from kindred.operators.score import HINT_CODES, TYPE_CODES
from kindred.plans.engine import ScanResult
from kindred.plans.session import Session


def text_report(result: ScanResult, most: int = 0) -> str:
    """Counts, and the visible findings, best first, with their regions, first hint and penalties. most: 0 for all."""
    s, n = Session(result), result.summary().first()
    lines = [f"{n.files} files, {n.functions} functions, {n.units} units, {n.visible} clones"]
    for i, f in enumerate(s.list_findings(limit=most).toLocalIterator(), 1):
        lines.append(f"{i}. [{f.composite:.2f}] {TYPE_CODES[f.type]} {f.id} similarity {f.similarity:.2f}")
        lines += [f"   {r.file}:{r.start_line}-{r.end_line} {r.func_name}" for r in f.regions]
        if f.hint:
            lines.append(f"   hint: {HINT_CODES[f.hint.category]} {f.hint.category} ({f.hint.confidence:.2f})")
        lines += [f"   penalty: {p.reason} x{p.factor:.2f}" for p in f.penalties]
    grades = {r.grade: r.findings for r in s.histogram().collect()}
    lines.append(", ".join(f"{g}: {grades.get(g, 0)}" for g in ("High", "Medium", "Low")))
    return "\n".join(lines) + "\n"


def json_report(result: ScanResult) -> str:
    """All findings, suppressed ones too. For large results use write_json."""
    rows = [r.asDict(recursive=True) for r in Session(result).findings.orderBy("rank" if "rank" in result.findings.columns else "finding_id").collect()]
    return json.dumps({"summary": result.summary().first().asDict(), "findings": rows}, indent=2, default=str)


def write_json(result: ScanResult, path: str) -> None:
    """All findings as JSON lines, written by the executors."""
    Session(result).findings.write.json(path)
