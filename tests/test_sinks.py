import os

from pyspark.sql import functions as F

from ticketlake.operators import changes, exports
from ticketlake.session import scratch_dir


def test_append_activity_and_export_writers(spark, tables):
    base = scratch_dir(spark, "test-sinks")
    act = os.path.join(base, "activity_logs")
    exports.append_activity(tables.activity_logs, act)
    log = changes.apply_note_changes(tables.notes, tables.note_changes, tables.clients).activity
    exports.append_activity(log, act)
    assert spark.read.parquet(act).count() == tables.activity_logs.count() + log.count()

    sheet = exports.export_notes(tables.notes, tables.clients, tables.users, tables.categories)
    csv_path = exports.write_table(sheet, os.path.join(base, "export_csv"), fmt="csv")
    back = spark.read.option("header", True).csv(csv_path)
    assert back.columns == exports.EXPORT_HEADERS and back.count() == tables.notes.count()
    pq_path = exports.write_table(sheet.withColumn("year", F.substring("Created", 1, 4)),
                                  os.path.join(base, "export_pq"), partition_by=["year"])
    assert spark.read.parquet(pq_path).count() == tables.notes.count()
