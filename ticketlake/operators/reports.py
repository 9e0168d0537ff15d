"""The summary, trend and export reports.

Every grouping is a hash aggregate with map-side partial aggregation, so a
hot status / category / agent costs one row per map task in the shuffle.
Facts are aggregated by key before they meet a dimension (aggregate, then
join). Whole-result numbers (share of total) use a scalar subquery rather
than a global window, so no operator funnels an unbounded result into one
task; global windows only run on bounded top-k results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions import expressions as E
from ticketlake.plans.joins import cut_lineage, lookup_for_small

def _count_status(s: str) -> Column:
    return F.count_if(F.col("status") == s).cast("bigint")


# A2 + A3 ----------------------------------------------------------------------
def totals(notes: DataFrame, clients: DataFrame) -> DataFrame:
    """One row: note counts by status, client count (inactive included), rate."""
    n_clients = clients.select(F.count(F.lit(1)).cast("bigint")).scalar()
    return (notes.agg(F.count(F.lit(1)).cast("bigint").alias("total_notes"),
                      _count_status("Open").alias("open_notes"),
                      _count_status("In Progress").alias("in_progress_notes"),
                      _count_status("Resolved").alias("resolved_notes"))
            .select("total_notes", "open_notes", "in_progress_notes", "resolved_notes",
                    n_clients.alias("total_clients"),
                    E.pct_rounded(F.col("resolved_notes"), F.col("total_notes")).alias("resolution_rate")))


# A4, A5 -----------------------------------------------------------------------
def count_by(notes: DataFrame, column: str) -> DataFrame:
    return notes.groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def by_status(notes: DataFrame) -> DataFrame:
    return count_by(notes, "status")


def by_priority(notes: DataFrame) -> DataFrame:
    return count_by(notes, "priority")


def status_priority_cube(notes: DataFrame) -> DataFrame:
    """One shuffle for A2/A4/A5: counts per (status, priority); the small result
    (at most |statuses| x |priorities| rows when the domains hold) is computed
    once and re-aggregated into totals, by_status and by_priority."""
    return cut_lineage(notes.groupBy("status", "priority").agg(F.count(F.lit(1)).cast("bigint").alias("count")))


def summary_from_cube(cube: DataFrame, clients: DataFrame) -> dict[str, DataFrame]:
    """totals / by_status / by_priority from one grouping of the notes."""
    tot = cube.agg(F.sum("count").cast("bigint").alias("total_notes"),
                   *[F.sum(F.when(F.col("status") == s, F.col("count")).otherwise(0)).cast("bigint").alias(a)
                     for s, a in (("Open", "open_notes"), ("In Progress", "in_progress_notes"),
                                  ("Resolved", "resolved_notes"))])
    n_clients = clients.select(F.count(F.lit(1)).cast("bigint")).scalar()
    totals_df = tot.select("*", n_clients.alias("total_clients"),
                           E.pct_rounded(F.col("resolved_notes"), F.col("total_notes")).alias("resolution_rate"))
    return {"totals": totals_df,
            "by_status": cube.groupBy("status").agg(F.sum("count").cast("bigint").alias("count")),
            "by_priority": cube.groupBy("priority").agg(F.sum("count").cast("bigint").alias("count"))}


# K4 + J12 ---------------------------------------------------------------------
def top_issues(notes: DataFrame, categories: DataFrame, k: int = 10) -> DataFrame:
    """Top k notes by counter (id breaks ties), with the category name joined
    after the limit."""
    top = cut_lineage(notes.select("id", "title", "counter", "status", "priority", "category_id")
                      .orderBy(F.col("counter").desc(), F.col("id").asc()).limit(k))
    out = lookup_for_small(top, "category_id", categories, "id", {"name": "category"})
    return out.select("id", "title", "counter", "status", "priority", "category")


# N1, E15, E16 -----------------------------------------------------------------
def top_issues_ranked(notes: DataFrame, categories: DataFrame, k: int = 10) -> DataFrame:
    """Top k with position, share of the top counter and the two severity
    buckets of the dashboard (by value) and the report (by position). The
    window runs over the k rows only."""
    top = top_issues(notes, categories, k)
    order = Window.orderBy(F.col("counter").desc(), F.col("id").asc())
    whole = Window.partitionBy(F.lit(1))
    return (top.withColumn("rank", F.row_number().over(order).cast("bigint"))
            .withColumn("top_counter", F.max("counter").over(whole))
            .withColumn("pct_of_top", F.round(F.col("counter") * 100.0 / F.col("top_counter"), 0).cast("bigint"))
            .withColumn("severity", E.severity_by_value(F.col("counter"), F.col("top_counter")))
            .withColumn("rank_severity", E.severity_by_rank(F.col("rank")))
            .drop("top_counter"))


# A8 + J9 ----------------------------------------------------------------------
def notes_per_category(notes: DataFrame) -> DataFrame:
    return (notes.where(F.col("category_id").isNotNull()).groupBy("category_id")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.sum("counter").cast("bigint").alias("occ")))


def by_category(notes: DataFrame, categories: DataFrame) -> DataFrame:
    """Root categories with notes tagged directly on them (no roll-up): count
    0 and occurrences NULL for a root without notes."""
    roots = categories.where(F.col("parent_id").isNull()).select("id", "name")
    agg = notes_per_category(notes)
    return (roots.join(agg, roots["id"] == agg["category_id"], "left")
            .select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
                    F.col("occ").alias("total_occurrences"))
            .orderBy(F.col("count").desc(), F.col("id").asc()))


# E17, E18, N3 -----------------------------------------------------------------
def category_share(notes: DataFrame, categories: DataFrame) -> DataFrame:
    """by_category plus percent of all root-tagged notes and the occurrences
    shown (count when occurrences are NULL or 0)."""
    bc = cut_lineage(by_category(notes, categories))  # read twice: its rows and their sum
    total = bc.select(F.sum("count")).scalar()
    return bc.select("*",
                     E.pct_rounded(F.col("count"), total, 0).cast("bigint").alias("share_pct"),
                     E.zero_or_null_fallback(F.col("total_occurrences"), F.col("count")).cast("bigint")
                     .alias("occurrences_shown"))


# A9, A10, E12 -----------------------------------------------------------------
def agent_stats(notes: DataFrame) -> DataFrame:
    resolved_hours = F.when(F.col("resolved_at").isNotNull(),
                            E.hours_between(F.col("created_at"), F.col("resolved_at")))
    return (notes.groupBy("agent_id")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 _count_status("Resolved").alias("r"),
                 _count_status("Open").alias("o"),
                 F.avg(resolved_hours).alias("h")))


def agent_performance(notes: DataFrame, users: DataFrame) -> DataFrame:
    """Every agent (role agent only, zero-note agents kept): totals, resolved,
    open, rate (NULL without notes), mean hours to resolve (one decimal)."""
    agents = users.where(F.col("role") == "agent").select("id", "name")
    st = agent_stats(notes)
    j = agents.join(st, agents["id"] == st["agent_id"], "left")
    total = F.coalesce("n", F.lit(0)).cast("bigint")
    resolved = F.coalesce("r", F.lit(0)).cast("bigint")
    return j.select(F.col("id").alias("agent_id"), F.col("name").alias("agent_name"),
                    total.alias("total_notes"), resolved.alias("resolved"),
                    F.coalesce("o", F.lit(0)).cast("bigint").alias("open"),
                    E.pct_rounded(resolved, total).alias("resolution_rate"),
                    F.round("h", 1).alias("avg_hours_to_resolve")).orderBy(F.col("total_notes").desc(),
                                                                           F.col("agent_id").asc())


# A12 --------------------------------------------------------------------------
def notes_per_agent(notes: DataFrame, users: DataFrame) -> DataFrame:
    agents = users.where(F.col("role") == "agent").select("id", "name")
    cnt = notes.groupBy("agent_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return (agents.join(cnt, agents["id"] == cnt["agent_id"], "left")
            .select(F.col("id").alias("agent_id"), "name",
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("notes"))
            .orderBy(F.col("notes").desc(), F.col("agent_id").asc()))


# A6, F12, E11, E13 ------------------------------------------------------------
def trend(notes: DataFrame, as_of, period: str = "monthly", months: int = 6) -> DataFrame:
    """Notes per week or month over the last N months before ``as_of``; empty
    periods give no row, the first one may be partial."""
    since = E.months_before(E.lit_ts(as_of), months)
    p = E.trunc_period(F.col("created_at"), period)
    return (notes.where(F.col("created_at") >= since)
            .groupBy(p.alias("period"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                 _count_status("Resolved").alias("resolved"),
                 _count_status("Open").alias("open"))
            .withColumn("label", E.period_label(F.col("period"), with_year=period != "weekly"))
            .orderBy("period"))


# A7, E7 -----------------------------------------------------------------------
def report_counts(notes: DataFrame) -> DataFrame:
    """PDF summary: total, resolved, open and a whole-number rate (0 if empty)."""
    return (notes.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                      _count_status("Resolved").alias("resolved"),
                      _count_status("Open").alias("open"))
            .withColumn("resolution_rate_pct", E.int_pct_or_zero(F.col("resolved"), F.col("total"))))


# A11 --------------------------------------------------------------------------
def export_summary(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count(F.lit(1)).cast("bigint").alias("total_notes"),
                     _count_status("Resolved").alias("resolved"),
                     _count_status("Open").alias("open"),
                     F.sum("counter").cast("bigint").alias("total_occurrences"))


SUMMARY_METRICS = ["total_notes", "resolved", "open", "total_occurrences"]


# S9, E22 ----------------------------------------------------------------------
def export_summary_kv(notes: DataFrame) -> DataFrame:
    """The summary sheet: one Metric/Value row per aggregate, names title-cased."""
    wide = export_summary(notes)
    long = wide.unpivot([], SUMMARY_METRICS, "key", "Value")
    return long.select(F.col("key").alias("metric_key"),
                       E.title_case_snake(F.col("key")).alias("Metric"),
                       F.col("Value").cast("bigint").alias("Value"))
