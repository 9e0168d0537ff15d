"""ST3: rate-limit windows that start at a key's own requests.

The tracker's limiter opens a window at a key's first request and the next one
at the first request at or after its end: a chain per key (``plans.chains``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import expressions as E
from ticketlake.plans.chains import BITS, chain
from ticketlake.plans.joins import cut_lineage
from ticketlake.plans.prefix import as_of

LIMITS = {"auth": 20, "all": 500}  # requests per window of the tracker's two limiters
WINDOW_US = 15 * 60 * 1_000_000


def anchored_windows(requests: DataFrame, limits: dict[str, int] = LIMITS, length: int = WINDOW_US) -> DataFrame:
    """Per window of ``requests`` (user_id, ts, requests): its start, end, number of
    requests, and per limit whether it is exceeded."""
    at = F.unix_micros(E.utc_instant(F.col("ts")))
    rows = cut_lineage(requests.where("user_id is not null and ts is not null")
                       .groupBy(F.col("user_id").alias("key"), at.alias("at")).agg(F.sum("requests").alias("n")))
    starts = chain(rows.select("key", "at", (F.col("at") + length).alias("until")))
    facts = starts.select("key", F.struct(F.col("at").alias("start")).alias("v"))
    rows = as_of(rows.withColumn("upto", F.col("at") + 1), facts, "key", "upto", "v", "w", bits=BITS)
    wall = lambda us: E.utc_wall_clock(F.timestamp_micros(us))
    return (rows.groupBy("key", F.col("w.start").alias("at")).agg(F.sum("n").cast("bigint").alias("requests"))
            .select(F.col("key").alias("user_id"), wall(F.col("at")).alias("window_start"),
                    wall(F.col("at") + length).alias("window_end"), "requests",
                    *((F.col("requests") > most).alias(f"over_{name}") for name, most in limits.items())))
