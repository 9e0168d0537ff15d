"""ST1-ST4: the tracker's continuously kept values as Structured Streaming jobs.

Sources are file streams over the driver's Parquet folder (one table picked
by ``pathGlobFilter``); on a cluster any streaming source with the same
columns works. No row is lost however late it comes, and none counts twice
however often it is delivered. Each job

* keeps the offsets and the keys it has seen in a checkpoint under the shared
  ``spark.checkpoint.dir``: ``dropDuplicates`` on the key, whose state Spark
  splits by the key's hash and keeps in RocksDB stores (on executors' disks, so
  it may outgrow memory; each batch adds its new keys to the changelog in the
  checkpoint, from which a lost executor's part is rebuilt). A key that comes
  again with another time is still the same key. With ``horizon`` the keys are
  forgotten once the event time has gone on by it, which ends the state's growth
  where redelivery is known to stop;
* evaluates a batch once, in ``foreachBatch``, into a ``run=N-N`` folder with
  overwrite, so a retried batch replaces itself, and goes on from that folder;
* writes aggregates as per-batch differences, which readers add up by key, so
  a late row is one more difference;
* folds ``COMPACT`` runs of equal width into one (``run=A-B``), ``COMPACT`` of
  these into the next width and so on: a row is written again log(batches)
  times. Runs that a wider one covers are removed a batch later.

``run_available_now`` drives a job over everything currently in the source;
the ``read_*`` functions give the result as a batch DataFrame from storage.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.functions import expressions as E
from ticketlake.operators.rate import anchored_windows
from ticketlake.session import scratch_dir
from ticketlake.sources.tables import activity_from_events, note_changes_from_events, raw

COMPACT = 32
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # counting a store's rows looks every key up once more when it is put
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@dataclass
class StreamPaths:
    checkpoint: str
    output: str

    def log(self, name: str) -> str:
        return os.path.join(self.output, name)


def new_paths(spark: SparkSession, name: str) -> StreamPaths:
    base = scratch_dir(spark, f"stream-{name}")
    return StreamPaths(os.path.join(base, "checkpoint"), os.path.join(base, "output"))


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store's settings; the
    given session's are left alone."""
    own = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (v := spark.conf.get(k, None)) is not None:
            own.conf.set(k, v)
    for k, v in STATE_CONF.items():
        own.conf.set(k, v)
    return own


def table_stream(spark: SparkSession, src_dir: str, table: str, name_glob: str | None = None,
                 files: int = 1000) -> DataFrame:
    """A file stream over the files of one table in ``src_dir`` (file names
    matching ``name_glob``, default ``{table}.parquet``); the schema comes
    from the Parquet footers (no data scan)."""
    glob = name_glob or f"{table}.parquet"
    schema = spark.read.option("pathGlobFilter", glob).parquet(src_dir).schema
    return (stream_session(spark).readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files).parquet(src_dir))


# Logs of runs -------------------------------------------------------------------
def _folders(spark: SparkSession, log: str) -> tuple[list[tuple[int, int]], object]:
    """The complete runs (first batch, last batch) of a log, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(log)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(top) if fs.exists(top) else ():
        m = re.fullmatch(r"run=(\d+)-(\d+)", status.getPath().getName())
        if m and fs.exists(path(status.getPath(), "_SUCCESS")):
            found.append((int(m[1]), int(m[2])))
    return found, fs


def _covering(runs: list[tuple[int, int]], before: int | None = None) -> list[tuple[int, int]]:
    """The widest runs up to batch ``before`` (exclusive), none inside another."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r for r in runs if before is None or r[1] < before), key=lambda r: (r[0], -r[1])):
        if not out or hi > out[-1][1]:
            out.append((lo, hi))
    return out


def read_log(spark: SparkSession, log: str, schema, before: int | None = None, since: int = 0) -> DataFrame:
    runs = [r for r in _covering(_folders(spark, log)[0], before) if r[0] >= since]
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{log}/run={lo}-{hi}" for lo, hi in runs))


def write_log(df: DataFrame, log: str, batch_id: int, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write a batch's rows and give them as read back. At batches COMPACT**k
    (counted from 1) the runs of the last COMPACT**k batches become one, folded."""
    spark = df.sparkSession
    runs, fs = _folders(spark, log)
    covering = _covering(runs, batch_id)
    for lo, hi in runs:  # covered before this batch began: no reader of this batch uses it
        if hi < batch_id and (lo, hi) not in covering:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{log}/run={lo}-{hi}"), True)
    df.write.mode("overwrite").parquet(f"{log}/run={batch_id}-{batch_id}")
    width = 1
    while (batch_id + 1) % (width * COMPACT) == 0:
        width *= COMPACT
    if width > 1:
        first = batch_id + 1 - width
        # a retried batch may find the wide run of its first try: the single runs are read
        rows = read_log(spark, log, df.schema, batch_id, since=first) \
            .unionByName(spark.read.schema(df.schema).parquet(f"{log}/run={batch_id}-{batch_id}"))
        fold(rows).write.mode("overwrite").parquet(f"{log}/run={first}-{batch_id}")
    return spark.read.schema(df.schema).parquet(f"{log}/run={batch_id}-{batch_id}")


def added(keys: list[str], values: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*keys).agg(*(F.sum(v).cast("bigint").alias(v) for v in values))


def _run(stream: DataFrame, paths: StreamPaths, key: str, at: Column, each: Callable[[DataFrame, int], None],
         horizon: str | None = None):
    """Start the stream: ``each`` gets the rows of a batch whose key no earlier
    row had, and the batch's number. It evaluates them once."""
    if horizon:
        fresh = (stream.withColumn("__at", E.utc_instant(at.cast("timestamp_ntz"))).withWatermark("__at", horizon)
                 .dropDuplicatesWithinWatermark([key]).drop("__at"))
    else:
        fresh = stream.dropDuplicates([key])
    return (fresh.writeStream.foreachBatch(each).option("checkpointLocation", paths.checkpoint)
            .trigger(availableNow=True).start())


def run_available_now(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# ST1 --------------------------------------------------------------------------
FEED = ("id bigint, user_id bigint, action string, target_type string, target_id bigint, target_name string, meta string, "
        "created_at timestamp_ntz, user_name string, user_role string")


def activity_stream(spark: SparkSession, src_dir: str, users: DataFrame, paths: StreamPaths,
                    name_glob: str | None = None, files: int = 1000, horizon: str | None = None):
    """Append-only activity feed enriched with the user, each id once."""
    u = users.select(F.col("id").alias("__uid"), F.col("name").alias("user_name"), F.col("role").alias("user_role"))

    def each(rows: DataFrame, batch_id: int) -> None:
        out = rows.join(u, F.col("user_id") == F.col("__uid"), "left").drop("__uid")
        write_log(out, paths.log("rows"), batch_id, lambda df: df)

    return _run(activity_from_events(table_stream(spark, src_dir, "events", name_glob, files)),
                paths, "id", F.col("created_at"), each, horizon)


def read_activity(spark, paths: StreamPaths) -> DataFrame:
    return read_log(spark, paths.log("rows"), FEED)


# ST2 --------------------------------------------------------------------------
NOTE_LOG = "note_id bigint, client_id bigint, ins_seq bigint, del_seq bigint"


def _note_states(df: DataFrame) -> DataFrame:
    """Per note its first insert (by request number) and its last delete."""
    first = F.min(F.when(F.col("ins_seq").isNotNull(), F.struct("ins_seq", "client_id")))
    return (df.groupBy("note_id").agg(first.alias("i"), F.max("del_seq").alias("del_seq"))
            .select("note_id", F.col("i.client_id").alias("client_id"), F.col("i.ins_seq").alias("ins_seq"), "del_seq"))


def counts_stream(spark: SparkSession, src_dir: str, notes: DataFrame, clients: DataFrame, paths: StreamPaths,
                  raw_dir: str | None = None, name_glob: str | None = None, files: int = 1000, horizon: str | None = None):
    """Running notes_count differences per client from the change stream. A
    log per note holds its first insert (with a title, for an existing
    client, no note of the snapshot) and its last delete; a batch adds the
    difference that it makes to the notes it touches, so the order of arrival
    doesn't matter and notes inserted by the stream can be deleted by it."""
    known = notes.select(F.col("id").alias("note_id"), F.col("client_id").alias("__snap"))
    cl = clients.select(F.col("id").alias("client_id"))

    def alive(inserted: str, deleted: str) -> Column:
        there = F.col("__snap").isNotNull() | F.col(inserted).isNotNull()
        gone = F.col(deleted).isNotNull() & (F.col("__snap").isNotNull() | (F.col(deleted) > F.col(inserted)))
        return there & ~F.coalesce(gone, F.lit(False))

    def each(rows: DataFrame, batch_id: int) -> None:
        ch = note_changes_from_events(spark, rows, raw_dir or src_dir).where(
            (F.col("op") == "delete") | ((F.col("op") == "insert") & E.not_blank(F.col("title"))))
        insert = F.col("op") == "insert"
        here = ch.join(cl.withColumn("__client", F.lit(True)), "client_id", "left").where(~insert | F.col("__client"))
        now = write_log(_note_states(here.select(
            "note_id", F.when(insert, F.col("client_id")).alias("client_id"), F.when(insert, F.col("seq")).alias("ins_seq"),
            F.when(~insert, F.col("seq")).alias("del_seq"))), paths.log("notes"), batch_id, _note_states)
        earlier = read_log(spark, paths.log("notes"), NOTE_LOG, batch_id).join(now.select("note_id"), "note_id", "left_semi")
        before = _note_states(earlier).select("note_id", F.col("client_id").alias("c0"), F.col("ins_seq").alias("i0"),
                                              F.col("del_seq").alias("d0"))
        after = _note_states(earlier.unionByName(now))
        # only the batch's notes of the snapshot meet the states: it is filtered, not shuffled, while they are few
        touched = known.join(now.select("note_id"), "note_id", "left_semi")
        j = after.join(before, "note_id", "left").join(touched, "note_id", "left")
        diff = (j.select(F.coalesce("__snap", "client_id").alias("client_id"),
                         alive("ins_seq", "del_seq").cast("bigint").alias("delta"))
                .unionByName(j.select(F.coalesce("__snap", "c0").alias("client_id"),
                                      (-alive("i0", "d0").cast("bigint")).alias("delta"))))
        write_log(diff.where("delta != 0 and client_id is not null").groupBy("client_id")
                  .agg(F.sum("delta").cast("bigint").alias("delta")),
                  paths.log("counts"), batch_id, added(["client_id"], ["delta"]))

    # a batch is shuffled by key as it is read: without the columns that the changes don't need
    events = table_stream(spark, src_dir, "events", name_glob, files).select("event_id", "ts", "user_id", "event_type", "props")
    return _run(events, paths, "event_id", F.col("ts"), each, horizon)


def read_counts(spark, paths: StreamPaths, notes: DataFrame, clients: DataFrame) -> DataFrame:
    """Count per client = recount of the snapshot + streamed differences,
    floored at 0 when read."""
    d = added(["client_id"], ["delta"])(read_log(spark, paths.log("counts"), "client_id bigint, delta bigint"))
    x0 = notes.groupBy("client_id").agg(F.count(F.lit(1)).cast("bigint").alias("x0"))
    j = (clients.select(F.col("id").alias("client_id")).join(x0, "client_id", "left").join(d, "client_id", "left"))
    return j.select("client_id", F.greatest(F.coalesce("x0", F.lit(0)) + F.coalesce("delta", F.lit(0)),
                                            F.lit(0)).cast("bigint").alias("notes_count"))


# ST3 --------------------------------------------------------------------------
RATE = "user_id bigint, window_start timestamp_ntz, window_end timestamp_ntz, requests bigint"
RATE_KEYS = ["user_id", "window_start", "window_end"]


def rate_windows_stream(spark: SparkSession, src_dir: str, paths: StreamPaths,
                        window: str = "15 minutes", name_glob: str | None = None, files: int = 1000,
                        horizon: str | None = None):
    """Requests per user per epoch-aligned tumbling window, and the requests
    themselves for windows that start at a request (``read_anchored_windows``)."""
    def each(rows: DataFrame, batch_id: int) -> None:
        rows = write_log(rows.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
                         .groupBy("user_id", "ts").agg(F.count(F.lit(1)).cast("bigint").alias("requests")),
                         paths.log("requests"), batch_id, added(["user_id", "ts"], ["requests"]))
        t = E.utc_instant(F.col("ts"))
        out = (rows.groupBy(F.window(t, window).alias("w"), "user_id")
               .agg(F.sum("requests").cast("bigint").alias("requests"))
               .select("user_id", E.utc_wall_clock(F.col("w.start")).alias("window_start"),
                       E.utc_wall_clock(F.col("w.end")).alias("window_end"), "requests"))
        write_log(out, paths.log("windows"), batch_id, added(RATE_KEYS, ["requests"]))

    return _run(table_stream(spark, src_dir, "events", name_glob, files), paths, "event_id", F.col("ts"), each, horizon)


def read_windows(spark, paths: StreamPaths) -> DataFrame:
    return added(RATE_KEYS, ["requests"])(read_log(spark, paths.log("windows"), RATE))


def read_rate_windows(spark, paths: StreamPaths, max_requests: int) -> DataFrame:
    """Windows above the limit (the request that exceeds ``max_requests``)."""
    return (read_windows(spark, paths).where(F.col("requests") > max_requests)
            .select("user_id", "window_start", "window_end", "requests"))


REQUESTS = "user_id bigint, ts timestamp_ntz, requests bigint"


def read_anchored_windows(spark, paths: StreamPaths, limits: dict[str, int], at_least: int = 1) -> DataFrame:
    """Windows as the tracker's limiter counts them: a user's first request opens
    one, and so does the first request at or after its end."""
    requests = added(["user_id", "ts"], ["requests"])(read_log(spark, paths.log("requests"), REQUESTS))
    return anchored_windows(requests, limits).where(F.col("requests") >= at_least)


# ST4 --------------------------------------------------------------------------
TREND = "period timestamp_ntz, total bigint, resolved bigint, open bigint"
TREND_VALUES = ["total", "resolved", "open"]


def trend_stream(spark: SparkSession, src_dir: str, paths: StreamPaths, as_of: str, months: int = 6,
                 period: str = "weekly", raw_dir: str | None = None, name_glob: str | None = None, files: int = 1000,
                 horizon: str | None = None):
    """A6 trend as a stream over new orders (a note per order with a
    customer): total / resolved / open per week or calendar month."""
    # a note exists for an order whose customer (and the customer's nation) exists
    dims = raw_dir or src_dir
    cust = (raw(spark, dims, "customer").select("c_custkey", "c_nationkey")
            .join(raw(spark, dims, "nation").select(F.col("n_nationkey")),
                  F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey"))
    created = F.col("o_orderdate").cast("timestamp_ntz")
    since = E.months_before(E.lit_ts(as_of), months)

    def each(rows: DataFrame, batch_id: int) -> None:
        out = (rows.join(cust, F.col("c_custkey") == F.col("o_custkey"), "left_semi").where(created >= since)
               .groupBy(E.trunc_period(created, period).alias("period"))
               .agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                    F.count_if(~F.col("o_orderstatus").isin("O", "P")).cast("bigint").alias("resolved"),
                    F.count_if(F.col("o_orderstatus") == "O").cast("bigint").alias("open")))
        write_log(out, paths.log("trend"), batch_id, added(["period"], TREND_VALUES))

    return _run(table_stream(spark, src_dir, "orders", name_glob, files), paths, "o_orderkey", created, each, horizon)


def read_trend(spark, paths: StreamPaths) -> DataFrame:
    return added(["period"], TREND_VALUES)(read_log(spark, paths.log("trend"), TREND))
