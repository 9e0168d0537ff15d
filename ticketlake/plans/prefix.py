"""Skew-safe running aggregates per key (prefix sum / running max).

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key in
one task; a hot key holding a third of the rows would run on one core. Here
the order column is cut into buckets of ``2**bits`` consecutive values:

1. within (key, bucket) a window computes the running value -- at most
   ``2**bits`` rows per window partition;
2. per (key, bucket) the bucket total is a partial-aggregated groupBy;
3. per key, a window over the bucket totals (one row per bucket) gives
   each bucket's offset (the total of all earlier buckets);
4. offset and in-bucket running value combine (sum: add; max: greatest).

The result is exact; no group is ever larger than a bucket or the bucket
count of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BITS = 16


def running(df: DataFrame, key: str, order: str, value: str, out: str, how: str = "sum",
            bits: int = DEFAULT_BITS) -> DataFrame:
    """Add column ``out`` = running ``how`` (sum or max) of ``value`` per ``key``
    over rows with ``order`` <= the row's order (``order`` unique per key)."""
    return running_all(df, key, order, {out: (value, how)}, bits)


def running_all(df: DataFrame, key: str, order: str, outs: dict[str, tuple[str, str]],
                bits: int = DEFAULT_BITS) -> DataFrame:
    """``running`` for several columns (out -> (value, how)) in one pass. The plan
    reads ``df`` twice, for the rows and for the buckets' totals, however many
    columns there are; one pass after the other reads it more often."""
    if any(how not in ("sum", "max") for _, how in outs.values()):
        raise ValueError(outs)
    agg = {out: F.sum if how == "sum" else F.max for out, (_, how) in outs.items()}
    b = F.floor(F.col(order) / F.lit(1 << bits)).cast("bigint")
    d = df.withColumn("__b", b)
    inner = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = d.groupBy(key, "__b").agg(*(agg[out](value).alias(f"__tot_{out}") for out, (value, _) in outs.items()))
    d = d.withColumns({f"__in_{out}": agg[out](value).over(inner) for out, (value, _) in outs.items()})
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "__b", *(agg[out](f"__tot_{out}").over(before).alias(f"__off_{out}") for out in outs))
    j = d.join(offsets, [key, "__b"], "left")
    cols = {}
    for out, (_, how) in outs.items():
        off, part = F.col(f"__off_{out}"), F.col(f"__in_{out}")
        cols[out] = (F.coalesce(off, F.lit(0)) + part if how == "sum"
                     else F.when(off.isNull(), part).otherwise(F.greatest(off, part)))
    return j.withColumns(cols).drop("__b", *(f"{c}{out}" for out in outs for c in ("__in_", "__off_")))


def as_of(asks: DataFrame, facts: DataFrame, key: str, at: str, value: str, out: str, bits: int = DEFAULT_BITS,
          start: str | None = None) -> DataFrame:
    """``asks`` with ``out`` = the ``value`` (a struct that begins with its own
    ``start``) of the fact of the same ``key`` with the largest ``start``
    strictly before ``at``, NULL without one. With a column ``start`` of its own
    for the facts' places, ``out`` is the largest ``value`` of the facts before. Both sides go through one running
    maximum, so neither a key with many facts nor one with many asks is joined
    all with all. ``(key, at)`` is unique among the asks and ``(key, start)``
    among the facts."""
    return as_of_all(asks, {out: facts}, key, at, value, bits, start)


def as_of_all(asks: DataFrame, facts: dict[str, DataFrame], key: str, at: str, value: str, bits: int = DEFAULT_BITS,
              start: str | None = None) -> DataFrame:
    """``as_of`` with several sets of facts (out -> facts) in one pass."""
    kinds = {out: f.schema[value].dataType for out, f in facts.items()}
    names = [c for c in asks.columns]
    rows = asks.select(*names, (F.col(at) * 2).alias("__at"), F.lit(True).alias("__ask"),
                       *(F.lit(None).cast(kind).alias(f"__v_{out}") for out, kind in kinds.items()))
    for out, f in facts.items():
        rows = rows.unionByName(f.select(key, (F.col(start or f"{value}.start") * 2 + 1).alias("__at"),
                                         F.col(value).alias(f"__v_{out}")), allowMissingColumns=True)
    return (running_all(rows, key, "__at", {out: (f"__v_{out}", "max") for out in facts}, bits)
            .where("__ask").select(*names, *facts))
