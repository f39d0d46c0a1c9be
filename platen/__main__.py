"""The command line: scan, tally, stages, schema and any registered query."""

from __future__ import annotations

import argparse
import json

from . import catalogue, schema


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m platen")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("schema", help="the catalog's tables and the edit document")
    sub.add_parser("stages", help="the develop stages in order")
    sub.add_parser("queries", help="names of the registered queries")
    scan = sub.add_parser("scan", help="compare a folder with the store's files")
    scan.add_argument("root")
    scan.add_argument("--store", required=True)
    scan.add_argument("--hash", action="store_true", help="also hash the files' contents")
    check = sub.add_parser("check", help="constraints of a store")
    check.add_argument("store")
    query = sub.add_parser("query", help="run a registered query and write or show its rows")
    query.add_argument("name")
    query.add_argument("tables", help="folder of the Parquet tables")
    query.add_argument("--out", help="folder to write Parquet to")
    args = p.parse_args(argv)

    if args.command == "schema":
        print(json.dumps({"version": schema.SCHEMA_VERSION, "tables": schema.TABLES, "edit": schema.EDIT}, indent=1))
        return 0
    if args.command == "stages":
        from .operators.session import STAGES

        for i, (stage, domain, preview) in enumerate(STAGES):
            print(i, stage, domain, "" if preview else "(not in previews)")
        return 0
    if args.command == "queries":
        print("\n".join(sorted(catalogue.queries())))
        return 0

    from .session import session

    spark = session()
    if args.command == "query":
        df = catalogue.queries()[args.name](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=80)
        return 0
    from .store import TableStore

    if args.command == "check":
        faults = TableStore(spark, args.store).check()
        print("\n".join(faults) or "no faults")
        return int(bool(faults))
    from pyspark.sql import functions as F

    from .operators import ingest
    from .sources import files

    found = files.listing(spark, args.root, contents=args.hash)
    known = files.known(TableStore(spark, args.store), args.root)
    actions = ingest.classified(found, known)
    actions.groupBy("action").agg(F.count("*").alias("files")).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
