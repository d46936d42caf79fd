"""Command line: list queries, or run one and write its result."""

from __future__ import annotations

import argparse

from tremorlab import plans
from tremorlab.session import build_session, reachable


def main(argv: list[str] | None = None) -> None:
    """``list``; ``run NAME --data DIR [--out PATH] [--format parquet|csv|json]``; ``sql NAME``."""
    ap = argparse.ArgumentParser(prog="tremorlab")
    sub = ap.add_subparsers(dest="do", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    run.add_argument("--master", default="local[*]")
    sql = sub.add_parser("sql")
    sql.add_argument("name")
    a = ap.parse_args(argv)
    if a.do == "list":
        print("\n".join(sorted(plans.queries())))
    elif a.do == "sql":
        print(plans.oracle_sql().get(a.name, "no SQL form"))
    else:
        df = plans.queries()[a.name](reachable(build_session(a.master)), a.data)
        df.write.format(a.format).option("header", True).save(a.out) if a.out else df.show(50, truncate=False)


if __name__ == "__main__":
    main()
