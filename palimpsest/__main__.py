"""``python -m palimpsest``: scan a file against a file or folder, list a registry, run a named query."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "scan-corpus"):
        p = sub.add_parser(name)
        p.add_argument("suspicious")
        p.add_argument("source")
        p.add_argument("--min-score", type=float, default=0.5)
        p.add_argument("--calibration-profile", help="its threshold comes before --min-score")
        p.add_argument("--semantic", action="store_true")
        p.add_argument("--semantic-min-score", type=float, default=0.72)
        p.add_argument("--semantic-top-k", type=int, default=5)
        p.add_argument("--output")
        p.add_argument("--html")
    p = sub.add_parser("catalog")
    p.add_argument("path")
    p = sub.add_parser("query")
    p.add_argument("name")
    p.add_argument("folder")
    p.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    if args.command == "catalog":
        from palimpsest.plans.registry import Registry

        registry = Registry.load(args.path)
        print(json.dumps({"models": list(registry.models), "datasets": list(registry.datasets), "enabled": registry.enabled("datasets")}, indent=2))
        return 0
    from palimpsest.scan import scan_files, session

    spark = session()
    if args.command == "query":
        from palimpsest.catalogue import QUERIES

        QUERIES[args.name](spark, args.folder).show(args.rows, truncate=80)
        return 0
    for path in (args.suspicious, args.source):
        if not Path(path).exists():
            print(f"No such file: {path}", file=sys.stderr)
            return 1
    threshold = args.min_score
    if args.calibration_profile:
        from palimpsest.plans.registry import load_calibration

        threshold = float(load_calibration(args.calibration_profile)["selected_threshold"])
    try:
        report = scan_files(spark, args.suspicious, args.source, threshold, args.semantic, args.semantic_min_score, args.semantic_top_k)
    except (ValueError, RuntimeError) as exc:
        print(str(exc), file=sys.stderr)
        return 1
    text = json.dumps(report, indent=2, sort_keys=True)
    if args.output:
        Path(args.output).write_text(text + "\n", encoding="utf-8")
    else:
        print(text)
    if args.html:
        from palimpsest.operators.reports import html_report

        Path(args.html).write_text(html_report(report), encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
