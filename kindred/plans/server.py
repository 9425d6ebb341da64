"""Scans and questions about them over JSON-RPC: one request a line on standard input, one answer a line on the output.

Scans are kept under the ids scan-1, scan-2 and so on for as long as the server runs; their results are written tables.
A page of findings is what gets to the driver, never all of them. Lines that aren't JSON objects are passed over.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import VERSION
from kindred.config import Config
from kindred.operators.score import HINT_CODES, TYPE_CODES
from kindred.plans.engine import ScanResult, analyze
from kindred.plans.session import Session, common_directory, stripped
from kindred.sources.code import code_units
from kindred.sources.files import read_files, region_text
from kindred.sources.guard import Guard, Refused

log = logging.getLogger("kindred")

# The protocol, error codes, and names and arguments of the tools.
PROTOCOL = "2024-11-05"
NO_METHOD, BAD_ARGUMENTS = -32601, -32602
PREVIEW, PAGE, SHORT_FORM = 5, 20, 200
TOOLS = {
    "scan": ("Finds clones below directories; answers with a summary and an id for the other tools.", {"paths": "array", "min_score": "number", "max_results": "integer"}, []),
    "list_findings": ("A page of a scan's findings, best first.", {"scan_id": "string", "min_score": "number", "limit": "integer", "offset": "integer"}, ["scan_id"]),
    "explain_finding": ("Scores, regions, normalized form and hint of one finding.", {"scan_id": "string", "finding_id": "string", "verbose": "boolean"}, ["scan_id", "finding_id"]),
    "compare_regions": (
        "The text of two regions of files that were scanned.",
        {"file_a": "string", "start_line_a": "integer", "end_line_a": "integer", "file_b": "string", "start_line_b": "integer", "end_line_b": "integer"},
        ["file_a", "start_line_a", "end_line_a", "file_b", "start_line_b", "end_line_b"],
    ),
}
_CODES = ", ".join(f"{code} {name}" for table in (TYPE_CODES, HINT_CODES) for name, code in table.items())
_KINDS = {"array": list, "number": (int, float), "integer": int, "string": str, "boolean": bool}


class Failed(Exception):
    """What a tool answers as an error of its own; the request itself was in order."""


class BadArguments(Exception):
    pass


def _checked(tool: str, given: object) -> dict:
    given = {} if given is None else given
    if not isinstance(given, dict):
        raise BadArguments("arguments must be an object")
    wanted = TOOLS[tool][1]
    for name, value in given.items():
        kind = wanted.get(name)
        if kind and (not isinstance(value, _KINDS[kind]) or isinstance(value, bool) != (kind == "boolean")):
            raise BadArguments(f"{name} must be of type {kind}")
    return {k: v for k, v in given.items() if k in wanted}


def _schema(tool: str) -> dict:
    properties = {k: {"type": v, "items": {"type": "string"}} if v == "array" else {"type": v} for k, v in TOOLS[tool][1].items()}
    return {"type": "object", "properties": properties} | ({"required": TOOLS[tool][2]} if TOOLS[tool][2] else {})


class Scans:
    """Finished scans by their ids, and texts about them."""

    def __init__(self, spark: SparkSession, cfg: Config, guard: Guard | None = None):
        self.spark, self.cfg, self.guard = spark, cfg, guard
        self.results: dict[str, ScanResult] = {}

    def found(self, scan_id: str) -> ScanResult:
        if scan_id not in self.results:
            raise Failed(f"scan_id not found: {scan_id}")
        return self.results[scan_id]

    def scan(self, paths: Iterable[str] = (), min_score: float = 0.0, max_results: int = 0) -> str:
        """Limits of 0 or less leave the settings as they are."""
        changes = {"min_score": float(min_score)} if min_score > 0 else {}
        cfg = self.cfg.with_values(changes | ({"max_findings": max_results} if max_results > 0 else {}))
        paths, begun = list(paths) or ["."], time.monotonic()
        try:
            for p in paths if self.guard else ():
                self.guard.resolved(p)
            files = read_files(self.spark, paths, cfg)
            result = analyze(files, code_units(files, cfg), cfg)
        except Exception as e:  # the answer names what went wrong, and the server goes on
            log.error("analysis failed: %s", e)
            raise Failed(f"analysis failed: {e}") from e
        scan_id = f"scan-{len(self.results) + 1}"
        self.results[scan_id] = result
        n = result.summary().first()
        lines = [f"{n.files} files {n.functions} funcs {round(1000 * (time.monotonic() - begun))}ms | {n.visible} clones | sid:{scan_id}"]
        lines += self._listed(result, Session(result).list_findings(limit=PREVIEW), 0, False)
        if n.visible > PREVIEW:
            lines.append(f"+{n.visible - PREVIEW} more: list_findings sid:{scan_id}")
        return "\n".join(lines) + "\n"

    def list_findings(self, scan_id: str = "", min_score: float = 0.0, limit: int = 0, offset: int = 0) -> str:
        """limit: 0 for a page of PAGE findings."""
        result, limit, offset = self.found(scan_id), limit if limit > 0 else PAGE, max(0, offset)
        s = Session(result)
        lines = self._listed(result, s.list_findings(min_score, offset, limit), offset, True)
        if rest := s.remaining(min_score, offset, limit):
            lines.append(f"+{rest} more (offset={offset + limit})")
        return "\n".join(lines) + "\n" if lines else "No findings match criteria."

    def explain_finding(self, scan_id: str = "", finding_id: str = "", verbose: bool = False) -> str:
        s = Session(self.found(scan_id))
        f = s.explain(finding_id).first()
        if f is None:
            raise Failed(f"finding not found: {finding_id}")
        lines = [f"{f.id} {TYPE_CODES[f.type]} {f.composite:.2f} conf={f.confidence:.2f} sim={f.similarity:.2f} imp={f.impact:.2f} ref={f.refactorability:.2f}"]
        lines += [f"  {r.file}:{r.start_line}-{r.end_line} {r.func_name}" for r in f.regions]
        if (row := s.normal_form(f.finding_id, 0 if verbose else SHORT_FORM + 1).first()) and row.form:
            cut = not verbose and len(row.form) > SHORT_FORM
            lines.append("norm: " + (row.form[:SHORT_FORM] + "... (set verbose:true for full)" if cut else row.form))
        if f.hint:
            lines.append(f"hint: {HINT_CODES[f.hint.category]} {f.hint.confidence * 100:.0f}% {f.hint.category}")
        if f.penalties:
            lines.append("penalties: " + " ".join(f"{p.reason}(×{p.factor:.1f})" for p in f.penalties))
        return "\n".join(lines) + "\n"

    def compare_regions(self, file_a="", start_line_a=0, end_line_a=0, file_b="", start_line_b=0, end_line_b=0) -> str:
        """Files are named as findings name them, or with their root before; other files aren't read."""
        parts = []
        for mark, file, start, end in (("A", file_a, start_line_a, end_line_a), ("B", file_b, start_line_b, end_line_b)):
            parts.append(f"{mark} {file.rsplit('/', 1)[-1]}:{start}-{end}\n{self._region(file, start, end)}\n")
        return "\n".join(parts)

    def _region(self, file: str, start: int, end: int) -> str:
        whole = F.concat(F.rtrim(F.col("root"), F.lit("/")), F.lit("/"), F.col("file"))
        for result in reversed(self.results.values()):
            rows = result.files.where((F.col("file") == file) | (whole == file)).orderBy(F.desc("root"))
            if row := rows.select(region_text(F.col("text"), start, end).alias("text")).first():
                return row.text
        raise Failed(f"read: no scan has this file: {file}")

    def _listed(self, result: ScanResult, page: DataFrame, offset: int, ids: bool) -> list[str]:
        at = result.findings.select(F.explode("regions.file").alias("file"))
        prefix = common_directory(at, "file").first().directory or ""
        shown = page.withColumn("files", F.transform("regions", lambda r: stripped(r["file"], prefix)))
        out = []
        for i, f in enumerate(shown.collect(), offset + 1):
            hint = f" →{HINT_CODES[f.hint.category]}" if f.hint else ""
            out.append(f"#{i} " + f"{f.id} " * ids + f"{f.composite:.2f} {TYPE_CODES[f.type]} {len(f.regions)}r{hint}")
            out += [f"  {name}:{r.start_line}-{r.end_line} {r.func_name}" for name, r in zip(f.files, f.regions, strict=True)]
        return out


def answer(scans: Scans, request: dict) -> dict | None:
    """The answer to a request, None if it needs none."""
    method, params = request.get("method"), request.get("params") or {}
    if method == "notifications/initialized":
        return None
    out = {"jsonrpc": "2.0"} | ({"id": request["id"]} if request.get("id") is not None else {})
    if method == "initialize":
        return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "kindred", "version": VERSION}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": t, "description": f"{d[0]} Codes: {_CODES}.", "inputSchema": _schema(t)} for t, d in TOOLS.items()]}}
    if method == "tools/call":
        if not isinstance(params, dict):
            return out | {"error": {"code": BAD_ARGUMENTS, "message": "invalid params"}}
        tool = params.get("name")
        if tool not in TOOLS:
            return out | {"error": {"code": NO_METHOD, "message": f"unknown tool: {tool}"}}
        try:
            text, failed = getattr(scans, tool)(**_checked(tool, params.get("arguments"))), False
        except BadArguments as e:
            return out | {"error": {"code": BAD_ARGUMENTS, "message": f"invalid arguments: {e}"}}
        except (Failed, Refused) as e:
            text, failed = f"Error: {e}", True
        return out | {"result": {"content": [{"type": "text", "text": text}]} | ({"isError": True} if failed else {})}
    return out | {"error": {"code": NO_METHOD, "message": f"unknown method: {method}"}} if "id" in out else None


def serve(scans: Scans, requests: Iterable[str], out) -> None:
    """Answers line after line until the requests end."""
    log.info("serving")
    for line in requests:
        try:
            request = json.loads(line)
        except ValueError:
            continue
        if isinstance(request, dict) and (said := answer(scans, request)) is not None:
            out.write(json.dumps(said, ensure_ascii=False) + "\n")
            out.flush()
