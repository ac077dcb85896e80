"""Run registered queries and write their results.

    python -m sway list
    python -m sway run <name> [<name> ...] --sf /root/testdata/sf0.01 --out /path/results [--format csv]

On a cluster submit the same module with spark-submit; the session's own settings
(including ``spark.checkpoint.dir``) are kept and only unset defaults are filled.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from sway.plans.catalog import load_all
from sway.session import build_session, configure
from sway.sources.study_files import write_table


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="sway")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    run = sub.add_parser("run", help="run queries and write their results")
    run.add_argument("names", nargs="+", help="query names, or 'all'")
    run.add_argument("--sf", required=True, help="folder with the input tables")
    run.add_argument("--out", required=True, help="output folder (one sub-folder per query)")
    run.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    run.add_argument("--master", default=None, help="Spark master when no session exists (local runs)")
    a = ap.parse_args(argv)
    reg = load_all()
    if a.cmd == "list":
        for name, q in reg.items():
            print(f"{name}\t{'oracle' if q.sql else 'rows-only'}")
        return 0
    active = SparkSession.getActiveSession()
    spark = configure(active) if active else build_session(a.master or "local[*]")
    names = list(reg) if a.names == ["all"] else a.names
    unknown = [n for n in names if n not in reg]
    if unknown:
        print(f"unknown queries: {', '.join(unknown)}", file=sys.stderr)
        return 2
    for n in names:
        df = reg[n].build(spark, a.sf)
        if a.format == "csv":
            # CSV cannot hold nested values: serialise arrays/maps/structs as JSON text
            from pyspark.sql import functions as F
            from pyspark.sql import types as T
            df = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                             if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
                             for f in df.schema.fields])
        write_table(df, os.path.join(a.out, n), a.format)
        print(f"wrote {n}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
