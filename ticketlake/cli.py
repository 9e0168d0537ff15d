"""Command line for cluster runs (``spark-submit``), e.g.

    spark-submit --py-files ticketlake.zip -m ticketlake.cli build <raw_dir> <out_dir>
    spark-submit ... -m ticketlake.cli run <query> <raw_or_built_dir> <out_path> [--format parquet|csv]
    spark-submit ... -m ticketlake.cli list

The session comes from the cluster (``getOrCreate``); its settings are not
changed, and ``spark.checkpoint.dir`` must name a shared folder there.
Results are written by the executors, never collected.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ticketlake")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build", help="derive the tracker tables from raw Parquet and write them")
    b.add_argument("raw_dir")
    b.add_argument("out_dir")
    r = sub.add_parser("run", help="run a registered query and write its result")
    r.add_argument("query")
    r.add_argument("data_dir")
    r.add_argument("out_path")
    r.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    sub.add_parser("list", help="list the registered queries")
    a = ap.parse_args(argv)

    from ticketlake.registry import QUERIES
    if a.cmd == "list":
        print("\n".join(sorted(QUERIES)))
        return 0

    spark = SparkSession.builder.appName(f"ticketlake-{a.cmd}").getOrCreate()
    from ticketlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    if a.cmd == "build":
        from ticketlake.sources.tables import Tables, materialize
        materialize(Tables(spark, a.raw_dir, derived=True), a.out_dir)
    else:
        from ticketlake.operators.exports import write_table
        write_table(QUERIES[a.query](spark, a.data_dir), a.out_path, fmt=a.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
