"""A versioned notes snapshot: a change rewrites only the months it touches.

``root/v=N/created_month=M`` holds the rows of month M as version N wrote them;
``root/manifest/v=N`` lists, per month, the version whose folder is valid. A
version counts once its manifest is complete (written last), so a job that dies
half way leaves the snapshot as it was, and a reader of an older version is not
disturbed. Folders of untouched months are never written again.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake import schemas
from ticketlake.sources.tables import MONTH

MANIFEST = f"{MONTH} date, version bigint"


def month_of(column: str = "created_at"):
    return F.make_date(F.year(column), F.month(column), F.lit(1))


def current(spark: SparkSession, root: str) -> int | None:
    """The newest version with a complete manifest."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(os.path.join(root, "manifest"))
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(m[1]) for s in (fs.listStatus(top) if fs.exists(top) else ())
             if (m := re.fullmatch(r"v=(\d+)", s.getPath().getName())) and fs.exists(path(s.getPath(), "_SUCCESS"))]
    return max(found, default=None)


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    """Month -> version (one entry per calendar month)."""
    rows = spark.read.schema(MANIFEST).parquet(os.path.join(root, "manifest", f"v={version}")).collect()
    return {r[MONTH]: r.version for r in rows}


def _write(rows: DataFrame, root: str, version: int) -> set:
    """Write rows by month; the months that have some."""
    out = os.path.join(root, f"v={version}")
    rows.withColumn(MONTH, month_of()).hint("rebalance", MONTH).sortWithinPartitions(MONTH, "updated_at") \
        .write.mode("overwrite").partitionBy(MONTH).parquet(out)
    spark = rows.sparkSession
    schema = T.StructType(schemas.NOTES.fields + [T.StructField(MONTH, T.DateType())])
    return {r[0] for r in spark.read.schema(schema).parquet(out).select(MONTH).distinct().collect()}


def _publish(spark: SparkSession, root: str, version: int, months: dict) -> int:
    spark.createDataFrame(sorted(months.items()), MANIFEST).coalesce(1) \
        .write.mode("overwrite").parquet(os.path.join(root, "manifest", f"v={version}"))
    return version


def create(notes: DataFrame, root: str) -> int:
    """The first version of a snapshot."""
    return _publish(notes.sparkSession, root, 0, dict.fromkeys(_write(notes, root, 0), 0))


def replace_months(root: str, rows: DataFrame, months: list) -> int:
    """A new version in which the given months hold the given rows (those of other
    months in ``rows`` are not written)."""
    spark = rows.sparkSession
    last = current(spark, root)
    kept = {m: v for m, v in manifest(spark, root, last).items() if m not in set(months)}
    wrote = _write(rows.where(month_of().isin(list(months))), root, last + 1) if months else set()
    return _publish(spark, root, last + 1, kept | dict.fromkeys(wrote, last + 1))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The notes of a version (the current one by default), with the month column
    for pruning."""
    version = current(spark, root) if version is None else version
    months = manifest(spark, root, version)
    schema = T.StructType(schemas.NOTES.fields + [T.StructField("v", T.LongType()), T.StructField(MONTH, T.DateType())])
    if not months:
        return spark.createDataFrame([], schema).drop("v")
    folders = [os.path.join(root, f"v={v}", f"{MONTH}={m.isoformat()}") for m, v in sorted(months.items())]
    return spark.read.schema(schema).option("basePath", root).parquet(*folders).drop("v")


def touched_months(notes: DataFrame, result) -> list:
    """The months of the notes that a change job inserted, changed or deleted."""
    ids = result.applied.select(F.col("note_id").alias("id")).distinct()
    old = notes.join(ids, "id", "left_semi").select(month_of().alias("m"))
    return [r.m for r in old.unionByName(result.inserted.select(month_of().alias("m"))).distinct().collect()]
