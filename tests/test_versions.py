"""A change rewrites the touched months of the snapshot only."""

import os

from pyspark.sql import functions as F

from ticketlake.sources import versions


def _files(root, version):
    top = os.path.join(root, f"v={version}")
    return {m: sorted(f for f in os.listdir(os.path.join(top, m)) if f.endswith(".parquet"))
            for m in os.listdir(top) if m.startswith(versions.MONTH)}


def test_untouched_months_keep_their_files(spark, tables, tmp_path):
    root = str(tmp_path / "notes")
    notes = tables.notes.where("created_at < timestamp_ntz'1995-07-01'")
    versions.create(notes, root)
    before = _files(root, 0)
    months = [r.m for r in notes.select(versions.month_of().alias("m")).distinct().orderBy("m").collect()]
    changed, gone = months[1], months[2]
    rows = notes.withColumn("title", F.when(versions.month_of() == changed, F.lit("new")).otherwise(F.col("title"))) \
        .where(versions.month_of() != gone)
    assert versions.replace_months(root, rows, [changed, gone]) == 1
    assert _files(root, 0) == before and list(_files(root, 1)) == [f"{versions.MONTH}={changed}"]
    now = versions.read(spark, root)
    assert sorted(map(tuple, now.drop(versions.MONTH).collect())) == sorted(map(tuple, rows.collect()))
    assert now.where(F.col(versions.MONTH) == changed).where("title != 'new'").isEmpty()
    assert versions.read(spark, root, 0).count() == notes.count()
    # a version without a complete manifest doesn't count
    os.remove(os.path.join(root, "manifest", "v=1", "_SUCCESS"))
    assert versions.current(spark, root) == 0
