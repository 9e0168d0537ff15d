"""Chains of intervals per key: greedy choice along the time axis.

Every point opens an interval ``[at, until)`` if it is taken; the first point of
a key is taken, and then always the first one at or after the end of the last
taken one. (Windows of a rate limiter, invitations that block further ones.)

A point at or after the ends of all earlier points is taken whatever was taken
before; these are the chain's certain members. Every other one points to the
first point at or after its own end, and members are followed along these
pointers by doubling: step k adds what lies 2**k intervals behind a member. A
key without any gap takes log2 of its number of intervals steps, and no window
of Spark's holds a whole key (``plans.prefix``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.plans.joins import cut_lineage
from ticketlake.plans.prefix import as_of

BITS = 37  # buckets of some 19 hours of doubled microseconds


def chain(points: DataFrame) -> DataFrame:
    """(key, at) of the taken ones among the ``points`` (key, at, until), times in
    microseconds, ``(key, at)`` unique, ``until`` after ``at``."""
    ends = points.select("key", "at", F.struct(F.col("until").alias("end")).alias("v"))
    back = points.select("key", F.struct((-F.col("at")).alias("start")).alias("v"))
    p = as_of(points, ends, "key", "at", "v", "busy", bits=BITS, start="at")
    certain = F.col("busy").isNull() | (F.col("busy.end") <= F.col("at"))
    p = p.select("key", "at", certain.alias("sure"), (1 - F.col("until")).alias("ask"), "until")
    # two points may end together: the questions are asked once
    asks = p.select("key", "ask").distinct()
    asks = as_of(asks, back, "key", "ask", "v", "next", bits=BITS).select("key", "ask", (-F.col("next.start")).alias("next"))
    p = cut_lineage(p.join(asks, ["key", "ask"]).select("key", "at", "sure", "next"))
    taken = p.where("sure").select("key", "at")
    # a pointer to a certain member adds nothing
    sure = taken.select("key", F.col("at").alias("next"))
    jump = cut_lineage(p.where("next is not null").select("key", "at", "next").join(sure, ["key", "next"], "left_anti")
                       .select("key", "at", "next"))
    while not jump.isEmpty():
        more = taken.join(jump, ["key", "at"]).select("key", F.col("next").alias("at"))
        taken = cut_lineage(taken.unionByName(more).distinct())
        jump = cut_lineage(jump.join(jump.select("key", F.col("at").alias("next"), F.col("next").alias("far")), ["key", "next"])
                           .select("key", "at", F.col("far").alias("next")))
    return taken
