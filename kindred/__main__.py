"""python -m kindred scan ROOT... [--level L] [--format text|json] [--min-score X] [-n N] [--config FILE] [--output FILE]
python -m kindred serve [--root ROOT...] [--log-file] [--config FILE]
python -m kindred version

serve answers JSON-RPC requests on standard input; with roots, it scans nothing outside them. Without --log-file it logs
errors alone; the log is on standard error in either case.

Exit status: 0 without visible findings, 1 with some, 2 for wrong settings, 3 if the run failed.
"""

from __future__ import annotations

import argparse
import sys

from kindred import VERSION
from kindred.config import load
from kindred.plans.logs import set_up


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kindred")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    serve = commands.add_parser("serve")
    serve.add_argument("--root", nargs="+", default=[], dest="roots")
    serve.add_argument("--log-file", action="store_true")
    serve.add_argument("--config")
    scan = commands.add_parser("scan")
    scan.add_argument("roots", nargs="+")
    scan.add_argument("--config")
    scan.add_argument("--output")
    for flag, key in (("--level", "level"), ("--format", "format"), ("--min-score", "min_score"), ("-n", "max_findings")):
        scan.add_argument(flag, dest=key)
    args = parser.parse_args(argv)
    if args.command == "version":
        print(f"kindred {VERSION}")
        return 0
    try:
        cfg = load(args.config).with_environment()
        cfg = cfg.with_values({k: v for k in ("level", "format", "min_score", "max_findings") if (v := getattr(args, k, None)) is not None})
    except (KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    if wrong := cfg.check():
        print("\n".join(wrong), file=sys.stderr)
        return 2
    try:
        if args.command == "serve":
            return serving(args.roots, cfg.with_values({} if args.log_file else {"log_level": "error"}))
        set_up(cfg.log_level, cfg.log_format)
        return run(args.roots, cfg, args.output)
    except Exception as e:  # noqa: BLE001
        print(f"the scan failed: {e}", file=sys.stderr)
        return 3


def serving(roots: list[str], cfg) -> int:
    from pyspark.sql import SparkSession

    from kindred.plans.server import Scans, serve
    from kindred.sources.guard import Guard

    set_up(cfg.log_level, cfg.log_format)
    guard = Guard(roots, cfg.max_file_size, cfg.follow_symlinks) if roots else None
    serve(Scans(SparkSession.builder.appName("kindred").getOrCreate(), cfg, guard), sys.stdin, sys.stdout)
    return 0


def run(roots: list[str], cfg, output: str | None) -> int:
    from pyspark.sql import SparkSession

    from kindred.plans.engine import analyze
    from kindred.plans.report import json_report, text_report
    from kindred.sources.code import code_units
    from kindred.sources.files import read_files

    spark = SparkSession.builder.appName("kindred").getOrCreate()
    files = read_files(spark, roots, cfg)
    result = analyze(files, code_units(files, cfg), cfg)
    report = json_report(result) if cfg.format == "json" else text_report(result)
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(report)
    else:
        print(report, end="")
    return int(result.findings.where("not suppressed").limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
