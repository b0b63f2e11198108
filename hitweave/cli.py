"""A small command line: index files into a store, search it, browse and delete.

    python -m hitweave.cli index STORE PATH [--format F] [--glob G]
    python -m hitweave.cli search STORE QUERY [--rpn | --infix | --smart] [--sort S] [--top N] [--style S] [--model M]
    python -m hitweave.cli scan STORE [PREFIX] [--field F]
    python -m hitweave.cli delete STORE KEY.. [--undelete]
    python -m hitweave.cli compact STORE NEW
    python -m hitweave.cli info STORE
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import scan, scoring, sorting
from .plans import Engine, QueryError, parse_infix, parse_rpn, search_smart
from .presentation import report
from .session import session
from .sources import read
from .streaming.store import Store


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hitweave", description="Index, search and browse collections.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in ("store", *places):
            p.add_argument(x)
        return p

    p = command("index", "path")
    p.add_argument("--format", default="AUTODETECT")
    p.add_argument("--glob")
    p.add_argument("--no-recursive", action="store_true")
    p = command("search", "query")
    p.add_argument("--rpn", action="store_true")
    p.add_argument("--infix", action="store_true")
    p.add_argument("--smart", action="store_true")
    p.add_argument("--sort", default="score")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--style", default="tab", choices=("terse", "tab", "json", "xml"))
    p.add_argument("--model", default="l2", choices=scoring.METHODS)
    p = command("scan")
    p.add_argument("pattern", nargs="?")
    p.add_argument("--field")
    p = command("delete")
    p.add_argument("keys", nargs="+")
    p.add_argument("--undelete", action="store_true")
    command("compact", "new")
    command("info")
    return top


def _next(store: Store) -> int:
    """The number of the next batch: one after the largest of records and deletions."""
    ends = [df.agg(F.max("batch")).first()[0] for df in (store._read("records", "batch long"), store._read("deleted", "batch long"))]
    return max((int(x) for x in ends if x is not None), default=-1) + 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments().parse_args(argv)
    spark = spark or session()
    store = Store(spark, args.store)
    out: DataFrame | None = None
    if args.command == "index":
        recs, exts = read(spark, args.path, args.format, args.glob, not args.no_recursive)
        store.append(_next(store), recs, exts)
        print(f"{store.live().count()} records")
    elif args.command == "search":
        c = store.collection()
        engine = Engine(c, model=args.model)
        try:
            if args.smart:
                found, used = search_smart(engine, args.query)
                print(f"query: {used}", file=sys.stderr)
            else:
                found = engine.compile(parse_rpn(args.query) if args.rpn else parse_infix(args.query) if args.infix else args.query)
        except QueryError as e:
            print(e, file=sys.stderr)
            return 1
        top = sorting.sort(found, c, args.sort).limit(args.top)
        place = {r.rec_id: n for n, r in enumerate(top.select("rec_id").collect())}
        lines = {r.rec_id: r.line for r in report(top, c, args.style).collect()}
        for rec in sorted(lines, key=lambda r: place.get(r, len(place))):
            print(lines[rec])
    elif args.command == "scan":
        out = scan.terms(store.collection(), args.pattern, field=args.field).orderBy("term")
    elif args.command == "delete":
        store.delete(_next(store), spark.createDataFrame([(k,) for k in args.keys], "key string"), restore=args.undelete)
    elif args.command == "compact":
        print(f"{store.compact(args.new).live().count()} records")
    else:
        c = store.collection()
        out = scan.term_statistics(c)
    if out is not None:
        for row in out.toLocalIterator():
            print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
