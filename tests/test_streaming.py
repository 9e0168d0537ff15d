"""Streams equal their batch equivalents; a stream restarted from its
checkpoint with new input continues where it stopped."""

import os
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from ticketlake import registry
from ticketlake.streaming import jobs


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rate_windows_restart_equals_batch(spark):
    """Input in two files; the second arrives after a first run and the
    stream restarts from its checkpoint. Result equals the batch count."""
    src = tempfile.mkdtemp(prefix="tl-src-")
    table = pq.read_table(os.path.join(SF_SMALL, "events.parquet"))
    half = table.num_rows // 2
    pq.write_table(table.slice(0, half), os.path.join(src, "events_1.parquet"))
    paths = jobs.new_paths(spark, "test-rate")
    jobs.run_available_now(jobs.rate_windows_stream(spark, src, paths, name_glob="events_*.parquet"))
    first = jobs.read_windows(spark, paths).count()
    pq.write_table(table.slice(half), os.path.join(src, "events_2.parquet"))
    jobs.run_available_now(jobs.rate_windows_stream(spark, src, paths, name_glob="events_*.parquet"))
    got = jobs.read_windows(spark, paths).select("user_id", "window_start", "requests")
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    expect = (ev.groupBy(F.col("user_id").cast("bigint").alias("user_id"),
                         F.window(F.col("ts").cast("timestamp"), "15 minutes").start.alias("w"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("requests"))
              .select("user_id", F.col("w").cast("timestamp_ntz").alias("window_start"), "requests"))
    assert 0 < first < got.count()
    assert _rows(got) == _rows(expect)


def test_results_do_not_depend_on_session_time_zone(spark):
    """Zone-free time handling: the weekly stream trend is the same in UTC and
    in a zone with daylight saving."""
    from ticketlake.registry import q_trend_stream, q_trend_week
    base = _rows(q_trend_week(spark, SF_SMALL).drop("label"))
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        other = _rows(q_trend_week(spark, SF_SMALL).drop("label"))
        streamed = _rows(q_trend_stream(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert base == other == streamed


def test_activity_stream_equals_batch(spark, tables):
    paths = jobs.new_paths(spark, "test-activity")
    jobs.run_available_now(jobs.activity_stream(spark, SF_SMALL, tables.users, paths))
    got = jobs.read_activity(spark, paths).select("id", "action", "user_name")
    u = tables.users.select(F.col("id").alias("uid"), F.col("name").alias("user_name"))
    expect = (tables.activity_logs.join(u, F.col("user_id") == F.col("uid"), "left")
              .select("id", "action", "user_name"))
    assert _rows(got) == _rows(expect)


def test_activity_stream_drops_repeated_events(spark, tables):
    """The same events delivered twice (two files) give each id once."""
    src = tempfile.mkdtemp(prefix="tl-dup-")
    table = pq.read_table(os.path.join(SF_SMALL, "events.parquet"))
    pq.write_table(table, os.path.join(src, "events_a.parquet"))
    pq.write_table(table.slice(0, table.num_rows // 3), os.path.join(src, "events_b.parquet"))
    paths = jobs.new_paths(spark, "test-dup")
    q = jobs.activity_stream(spark, src, tables.users, paths, name_glob="events_*.parquet")
    jobs.run_available_now(q)
    got = jobs.read_activity(spark, paths)
    assert got.count() == got.select("id").distinct().count() == table.num_rows


def test_late_and_repeated_rows_count_once(spark, tables, monkeypatch):
    """Every second row arrives in a later batch, and all of them again; logs
    are folded on the way. Nothing is lost or counted twice."""
    monkeypatch.setattr(jobs, "COMPACT", 2)
    for table, run, read, base in (
            ("events", lambda s, p: jobs.activity_stream(spark, s, tables.users, p, name_glob="x_*.parquet"),
             jobs.read_activity, "activity_stream"),
            ("events", lambda s, p: jobs.rate_windows_stream(spark, s, p, name_glob="x_*.parquet"),
             lambda sp, p: jobs.read_rate_windows(sp, p, 1), "rate_windows"),
            ("events", lambda s, p: jobs.counts_stream(spark, s, tables.notes, tables.clients, p, raw_dir=SF_SMALL,
                                                       name_glob="x_*.parquet"),
             lambda sp, p: jobs.read_counts(sp, p, tables.notes, tables.clients), "counts_stream"),
            ("orders", lambda s, p: jobs.trend_stream(spark, s, p, registry.AS_OF_NOTES, raw_dir=SF_SMALL,
                                                      name_glob="x_*.parquet"), jobs.read_trend, "trend_stream")):
        src, paths = tempfile.mkdtemp(prefix="tl-late-"), jobs.new_paths(spark, "test-late")
        rows = pq.read_table(os.path.join(SF_SMALL, f"{table}.parquet"))
        odd = [i for i in range(rows.num_rows) if i % 2]
        for k, part in enumerate((rows.take(odd), rows, rows.take(odd[::-1]))):
            pq.write_table(part, os.path.join(src, f"x_{k}.parquet"))
            jobs.run_available_now(run(src, paths))
        assert _rows(read(spark, paths).select(sorted(read(spark, paths).columns))) == _rows(
            (d := registry.QUERIES[base](spark, SF_SMALL)).select(sorted(d.columns))), base


def test_counts_of_notes_inserted_and_deleted_by_the_stream(spark):
    """A delete counts whenever it arrives, if it was asked for after the insert."""
    rows = [(1, 10, 5, None), (1, None, None, 9), (2, 10, 7, None), (2, None, None, 6), (3, 11, 8, None), (3, 10, 4, None)]
    df = spark.createDataFrame(rows, jobs.NOTE_LOG)
    got = {r.note_id: (r.client_id, r.ins_seq, r.del_seq) for r in jobs._note_states(df).collect()}
    assert got == {1: (10, 5, 9), 2: (10, 7, 6), 3: (10, 4, None)}


def test_counts_state_keeps_keys_only_and_drops_unused_columns(spark, tables):
    """A batch comes without the event's value, and the state store doesn't look its keys up to count them."""
    src, paths, seen = tempfile.mkdtemp(prefix="tl-cols-"), jobs.new_paths(spark, "test-cols"), []
    pq.write_table(pq.read_table(os.path.join(SF_SMALL, "events.parquet")), os.path.join(src, "x_0.parquet"))
    run = jobs._run
    try:
        jobs._run = lambda stream, *a: seen.append(stream) or run(stream, *a)
        jobs.run_available_now(jobs.counts_stream(spark, src, tables.notes, tables.clients, paths, raw_dir=SF_SMALL, name_glob="x_*.parquet"))
    finally:
        jobs._run = run
    assert "value" not in seen[0].columns
    assert seen[0].sparkSession.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"
    assert _rows(jobs.read_counts(spark, paths, tables.notes, tables.clients)) == _rows(registry.QUERIES["counts_stream"](spark, SF_SMALL))
