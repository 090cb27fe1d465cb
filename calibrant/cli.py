"""Command line over the library: run a named query, list queries, show a configuration."""

from __future__ import annotations

import argparse

from calibrant import config, registry
from calibrant.session import local_session
from calibrant.sources.files import markdown_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="calibrant")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a query and show or write its rows")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out")
    sub.add_parser("list", help="list queries")
    info = sub.add_parser("config", help="show the configuration that results from a file and overrides")
    info.add_argument("--file")
    info.add_argument("overrides", nargs="*", metavar="key=value")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(registry.queries())))
    elif a.command == "config":
        print(config.dump(config.load(a.file, dict(x.split("=", 1) for x in a.overrides))))
    else:
        df = registry.queries()[a.query](local_session(), a.folder)
        df.write.parquet(a.out) if a.out else print(markdown_table(df, 20))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
