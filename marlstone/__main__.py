"""Command line: ``python -m marlstone list | run NAME | sql TEXT | call TOOL | manifest | report``.

``run`` and ``sql`` write Parquet to ``--out`` or print some rows; tables are those of ``--data``, and ``sql`` sees each by its
name. ``call`` takes ``name=value`` arguments and the viewer's principal, tenant and groups.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", description="Queries, tools and reports over a folder of tables.")
    p.add_argument("--data", default=os.environ.get("MARLSTONE_DATA", "."), help="folder of NAME.parquet")
    sub = p.add_subparsers(dest="do", required=True)
    sub.add_parser("list", help="names of the registered queries")
    for name, what in (("run", "a registered query"), ("sql", "Spark SQL over the tables")):
        s = sub.add_parser(name, help=what)
        s.add_argument("what")
        s.add_argument("--out", help="write Parquet here")
        s.add_argument("--rows", type=int, default=20, help="rows printed without --out")
    c = sub.add_parser("call", help="a tool, as a viewer")
    c.add_argument("what")
    c.add_argument("arguments", nargs="*", metavar="NAME=VALUE")
    c.add_argument("--principal", required=True)
    c.add_argument("--tenant", default="default")
    c.add_argument("--group", action="append", default=[])
    sub.add_parser("manifest", help="the tools as JSON schema")
    sub.add_parser("report", help="the measures as a page of HTML").add_argument("--out", required=True)
    return p


def _give(df: DataFrame, out: str | None, rows: int) -> None:
    if out:
        df.write.mode("error").parquet(out)  # never over what is there
    else:
        df.show(rows, truncate=80)


def _tables(spark: SparkSession, data: str) -> None:
    """Every table of the folder as a view, by Spark's own listing: the folder may be in any store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(data)
    for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
        name = f.getPath().getName()
        if name.endswith(".parquet"):
            spark.read.parquet(f.getPath().toString()).createOrReplaceTempView(name.removesuffix(".parquet"))


def arguments(tool: str, pairs: list[str]) -> dict:
    """NAME=VALUE by the types of the tool's contract."""
    from marlstone.tools import TOOLS

    kinds = {k: kind for k, (kind, _) in TOOLS[tool].arguments.items()} if tool in TOOLS else {}
    read = {int: int, bool: lambda v: {"true": True, "false": False}[v.lower()], list: lambda v: v.split(",")}
    return {k: read.get(kinds.get(k, str), str)(v) for k, _, v in (p.partition("=") for p in pairs)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.do == "manifest":
        from marlstone.tools import manifest

        print(json.dumps(manifest(), indent=1))
        return 0
    from marlstone.plans import registry

    if a.do == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    if a.do == "run" and a.what not in registry.queries():
        print(f"unknown query {a.what}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("marlstone").getOrCreate()
    if a.do == "run":
        _give(registry.queries()[a.what](spark, a.data), a.out, a.rows)
    elif a.do == "sql":
        _tables(spark, a.data)
        _give(spark.sql(a.what), a.out, a.rows)
    elif a.do == "call":
        from marlstone.tools import Viewer, call

        got = call(spark, a.data, Viewer(a.principal, a.tenant, tuple(a.group)), a.what, **arguments(a.what, a.arguments))
        print(json.dumps(got, default=str, ensure_ascii=False, indent=1))
        return 1 if "error" in got else 0
    else:
        from marlstone.report import report

        with open(a.out, "w", encoding="utf-8") as f:
            f.write(report(spark, a.data))
    return 0


if __name__ == "__main__":
    sys.exit(main())
