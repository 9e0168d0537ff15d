"""Join shapes used across the operators.

Size discipline:

* Dimension joins over whole tables are left to the planner: a side is
  broadcast only when its measured size is under
  ``spark.sql.autoBroadcastJoinThreshold`` (statically from file statistics or
  at runtime by AQE from the shuffle output); otherwise it is a sort-merge or
  shuffled-hash join. No unconditional ``broadcast()`` on a table that grows.
* ``lookup_for_small`` enriches a result that is bounded by construction (a
  page or a top-k, at most ``PAGE_MAX_LIMIT`` rows): the bounded keys are
  broadcast into a semi join that filters the dimension scan, so the large
  dimension is streamed once and never shuffled; the few surviving rows are
  then joined back (AQE broadcasts them at runtime).
* Aggregate-then-join: facts are reduced by the join key first (partial
  aggregation on the map side), so a hot key costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.session import scratch_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it as a table in the shared folder
    (``spark.checkpoint.dir``), so a result used by several branches of a
    plan is not recomputed per branch and survives a lost executor. Used for
    bounded results (pages, top-k) and for intermediates read several times.
    Written once, unlike a reliable checkpoint, which computes its input twice
    or needs it persisted; small results come back as one partition."""
    spark = df.sparkSession
    path = scratch_dir(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MAX_BROADCAST_ROWS = 100_000


def within_broadcast_bound(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Size check before an explicit broadcast: counts at most max_rows + 1
    rows of an already computed (checkpointed) result."""
    return small.limit(max_rows + 1).count() <= max_rows


def lookup_for_small(small: DataFrame, small_key: str, dim: DataFrame, dim_key: str,
                     columns: dict[str, str], bounded: bool | None = None) -> DataFrame:
    """Left-join ``columns`` (dim column -> output alias) of ``dim`` onto a
    bounded result ``small`` on ``small.small_key = dim.dim_key``.

    ``small`` is a page / top-k already computed (``cut_lineage``); its
    distinct keys are the only broadcast data. The bound is checked
    (``bounded`` passes a check already made); beyond it the lookup is a
    plain join sized by the planner.
    """
    if bounded is None:
        bounded = within_broadcast_bound(small)
    if not bounded:
        return left_lookup(small, small_key, dim, dim_key, columns)
    keys = small.select(F.col(small_key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    # the keys' range, as scalar subqueries, reaches the Parquet reader as a
    # runtime filter: row groups of a dimension written in key order are skipped
    # (two subqueries over different plans: merged into one, their fields aren't pushed)
    lo = keys.select(F.min("__k")).scalar()
    hi = small.select(F.max(small_key)).scalar()
    in_range = dim.where((F.col(dim_key) >= lo) & (F.col(dim_key) <= hi))
    needed = in_range.join(F.broadcast(keys), F.col(dim_key) == F.col("__k"), "left_semi")
    proj = needed.select(F.col(dim_key).alias("__dk"),
                         *[F.col(c).alias(a) for c, a in columns.items()])
    return small.join(proj, F.col(small_key) == F.col("__dk"), "left").drop("__dk")


def left_lookup(facts: DataFrame, fact_key: str, dim: DataFrame, dim_key: str,
                columns: dict[str, str]) -> DataFrame:
    """Left-join dimension columns onto a whole fact table (planner picks the
    strategy by measured size)."""
    proj = dim.select(F.col(dim_key).alias("__dk"), *[F.col(c).alias(a) for c, a in columns.items()])
    return facts.join(proj, F.col(fact_key) == F.col("__dk"), "left").drop("__dk")
