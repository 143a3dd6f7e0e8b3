"""Command line over a catalogue of JSON files: list, query, show, stats, enrich, load, quality."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, enrich, filters, quality, search
from .sources import catalog, sinks


def _show(df: DataFrame, fmt: str, fields: list[str] | None = None) -> str:
    """Rows of a page as a table, JSON or CSV."""
    df = filters.project(df, fields) if fields else df
    if fmt == "json":
        return json.dumps([json.loads(x) for x in df.toJSON().collect()], indent=2, ensure_ascii=False)
    rows = [[r[c] for c in df.columns] for r in df.collect()]
    if fmt == "csv":
        import csv
        import io

        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([df.columns, *[["" if v is None else v for v in r] for r in rows]])
        return out.getvalue().rstrip("\n")
    return sinks.text_table(rows, df.columns)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrion")
    p.add_argument("--data", default="data", help="folder of the catalogue's JSON files")
    sub = p.add_subparsers(dest="command", required=True)
    formats = {"choices": ("table", "json", "csv"), "default": "table"}
    a = sub.add_parser("list")
    a.add_argument("--vendor")
    a.add_argument("--format", **formats)
    a = sub.add_parser("query")
    for name in ("vendor", "arch", "gpu", "source", "search", "sort", "fields"):
        a.add_argument(f"--{name}")
    for name, kind in (("year", int), ("min-cores", int), ("min-ghz", float), ("min-completeness", float), ("limit", int), ("offset", int)):
        a.add_argument(f"--{name}", type=kind)
    a.add_argument("--desc", action="store_true")
    a.add_argument("--format", **formats)
    a = sub.add_parser("show")
    a.add_argument("id")
    sub.add_parser("stats")
    for name in ("enrich", "load"):
        a = sub.add_parser(name)
        a.add_argument("--out", required=True)
        a.add_argument("--force", action="store_true")
    a = sub.add_parser("quality-report")
    a.add_argument("--format", choices=("json", "markdown"), default="markdown")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarrion").getOrCreate()
    raw = catalog.read_json(spark, args.data)
    df = raw.drop("_file", "_pos")
    if args.command == "list":
        df = filters.facet_filter(df, vendor=args.vendor)
        print(_show(aggregates.group_summary(df), args.format))
    elif args.command == "query":
        hits = search.search(df, args.search, "id", ["name", "vendor", "model", "description", "architecture", "gpu"]) if args.search and args.search.strip() else None
        wanted = {k: getattr(args, k) for k in ("vendor", "arch", "gpu", "year", "min_cores", "min_ghz", "min_completeness", "source")}
        rows, total = filters.filter_records(df, hits, args.sort, args.desc, args.limit, args.offset or 0, **wanted)
        fields = args.fields.split(",") if args.fields else ["id", "name", "vendor", "model", "year", "cores"]
        print(_show(rows, args.format, fields))
        if args.format == "table":
            print(f"{total} records")
    elif args.command == "show":
        found = catalog.by_id(df, args.id)
        if found.isEmpty():
            print(f"not found: {args.id}", file=sys.stderr)
            return 1
        print(_show(found, "json"))
    elif args.command == "stats":
        print(_show(aggregates.global_stats(df), "json"))
    elif args.command == "enrich":
        sinks.write_vendors(enrich.enrich(df), args.out)
    elif args.command == "load":
        print(json.dumps(sinks.load(raw.withColumn("_pos", F.concat_ws(":", "_file", F.lpad("_pos", 9, "0"))).drop("_file"), args.out, force=args.force), ensure_ascii=False))
    else:
        report = quality.QualityReport(df)
        print(report.to_json() if args.format == "json" else report.markdown())
    return 0


if __name__ == "__main__":
    sys.exit(main())
