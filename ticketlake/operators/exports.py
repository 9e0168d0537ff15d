"""Export datasets and sinks.

The export sheet is the whole notes table joined to three dimensions; the
planner picks the join strategy from measured sizes. The "newest first" order
is a distributed range sort. Writers go to a new folder (never the one being
read), optionally partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions import expressions as E
from ticketlake.operators import reports

# Sheet headers of the note export, in sheet order (fixed values).
EXPORT_HEADERS = ["ID", "Title", "Client", "Category", "Agent", "Priority", "Status", "Counter", "Created"]


def export_notes(notes: DataFrame, clients: DataFrame, users: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per note with names, created as a date string,
    newest first (id breaks ties)."""
    cl = clients.select(F.col("id").alias("__c"), F.col("name").alias("Client"))
    us = users.select(F.col("id").alias("__u"), F.col("name").alias("Agent"))
    ca = categories.select(F.col("id").alias("__k"), F.col("name").alias("Category"))
    j = (notes.select("id", "title", "client_id", "agent_id", "category_id", "priority", "status",
                      "counter", "created_at")
         .join(cl, F.col("client_id") == F.col("__c"), "left")
         .join(us, F.col("agent_id") == F.col("__u"), "left")
         .join(ca, F.col("category_id") == F.col("__k"), "left"))
    return (j.orderBy(F.col("created_at").desc(), F.col("id").desc())
            .select(F.col("id").alias("ID"), F.col("title").alias("Title"), "Client", "Category", "Agent",
                    F.col("priority").alias("Priority"), F.col("status").alias("Status"),
                    F.col("counter").alias("Counter"), E.date_string(F.col("created_at")).alias("Created")))


def pdf_top_issues(notes: DataFrame, k: int = 10) -> DataFrame:
    """Numbered top 10 recurring issues (title, counter, status)."""
    top = (notes.select("id", "title", "counter", "status")
           .orderBy(F.col("counter").desc(), F.col("id").asc()).limit(k))
    w = Window.orderBy(F.col("counter").desc(), F.col("id").asc())
    return top.withColumn("position", F.row_number().over(w).cast("bigint"))


def pdf_report(notes: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """The three result tables of the PDF report."""
    return {"summary": reports.report_counts(notes), "top_issues": pdf_top_issues(notes),
            "agents": reports.notes_per_agent(notes, users)}


def summary_document(notes, clients, users, categories) -> dict[str, DataFrame]:
    """The combined summary as named DataFrames (each computed by Spark;
    callers write or show them, nothing is assembled on the driver). The
    three status/priority counts share one grouping of the notes."""
    shared = reports.summary_from_cube(reports.status_priority_cube(notes), clients)
    return {**shared, "top_issues": reports.top_issues(notes, categories),
            "by_category": reports.by_category(notes, categories),
            "agent_performance": reports.agent_performance(notes, users)}


def summary_rows(document: dict[str, DataFrame]) -> DataFrame:
    """S11 as one table (section, name, value): the totals by name, and of every
    other section its label and its count."""
    def rows(section: str, name: str, value: str) -> DataFrame:
        return document[section].select(F.lit(section).alias("section"), F.col(name).alias("name"),
                                        F.col(value).cast("double").alias("value"))
    totals = document["totals"]
    out = totals.select([F.col(c).cast("double").alias(c) for c in totals.columns]) \
        .unpivot([], totals.columns, "name", "value").select(F.lit("totals").alias("section"), "name", "value")
    for section, name, value in (("by_status", "status", "count"), ("by_priority", "priority", "count"),
                                 ("top_issues", "title", "counter"), ("by_category", "name", "count"),
                                 ("agent_performance", "agent_name", "total_notes")):
        out = out.unionByName(rows(section, name, value))
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "errorifexists") -> str:
    """S8 / S12 sink: write a DataFrame as Parquet or CSV (with header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def append_activity(rows: DataFrame, table_path: str) -> str:
    """Append activity rows (e.g. a change job's log) to the activity
    table; appends add new files, existing files are never rewritten."""
    from ticketlake import schemas
    cols = [f.name for f in schemas.ACTIVITY_LOGS.fields]
    rows.select(*cols).write.mode("append").parquet(table_path)
    return table_path
