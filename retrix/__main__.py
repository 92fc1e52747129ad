"""Command line: ``python -m retrix list`` and ``python -m retrix run NAME DIR [--rows N] [--out PATH]``."""

from __future__ import annotations

import argparse
import json


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="retrix", description="Run the library's queries on a folder of Parquet tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("name")
    run.add_argument("directory")
    run.add_argument("--rows", type=int, default=20, help="rows to print")
    run.add_argument("--out", help="folder to write the whole result to, as Parquet")
    run.add_argument("--explain", action="store_true", help="print the plan instead of running")
    given = parser.parse_args(arguments)
    from retrix.plans.catalogue import ORACLE, QUERIES

    if given.command == "list":
        for name, function in sorted(QUERIES.items()):
            print(f"{name:28} {'sql' if name in ORACLE else '   '}  {(function.__doc__ or '').strip().splitlines()[0]}")
        return 0
    if given.name not in QUERIES:
        parser.error(f"no query is named {given.name}")
    from retrix.session import session

    frame = QUERIES[given.name](session(), given.directory)
    if given.explain:
        frame.explain("formatted")
    elif given.out:
        frame.write.mode("overwrite").parquet(given.out)
    else:
        for row in frame.take(given.rows):
            print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
