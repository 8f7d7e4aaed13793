"""Runs registered queries from the command line.

    python -m tidelog --list
    python -m tidelog QUERY FOLDER [--out PATH]
"""

from __future__ import annotations

import argparse

from tidelog.plans import catalog
from tidelog.session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidelog")
    p.add_argument("query", nargs="?", choices=sorted(catalog.QUERIES), metavar="QUERY")
    p.add_argument("folder", nargs="?", help="of the tables")
    p.add_argument("--list", action="store_true", help="the queries and the inventory rows they show")
    p.add_argument("--out", help="writes the result as Parquet instead of printing rows")
    args = p.parse_args(argv)
    if args.list:
        for name, rows in sorted(catalog.INVENTORY.items()):
            print(f"{name}\t{rows}")
        return 0
    if not args.query or not args.folder:
        p.error("a query and a folder are needed")
    result = catalog.QUERIES[args.query](session(args.query), args.folder)
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    else:
        result.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
