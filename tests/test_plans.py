"""Plan shape: pushdown and pruning reach the scan, pages are bounded top-k,
per-group top-k is limited before the shuffle, no Python UDF anywhere."""

import pytest

import __spark_entry__ as se
from tests.conftest import SF_SMALL
from ticketlake.functions.paging import paginate
from ticketlake.operators import lists, reports
from ticketlake.operators.filters import NoteQuery


def plan_of(df) -> str:
    """The formatted physical plan (what ``explain("formatted")`` prints)."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def t(spark):
    from ticketlake.sources.tables import load_tables
    return load_tables(spark, SF_SMALL)


def test_filters_reach_parquet_scan(t):
    q = NoteQuery(status="Open", date_from="1996-01-01")
    p = plan_of(lists.notes_count(t.notes, q))
    assert "EqualTo(status,Open)" in p and "GreaterThanOrEqual(created_at" in p


def test_column_pruning(t):
    p = plan_of(reports.by_priority(t.notes))
    schemas_read = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    assert schemas_read == ["ReadSchema: struct<priority:string>"]


def test_page_is_bounded_top_k(t):
    q = NoteQuery(status="Open")
    rows = t.notes.where(q.predicate()).orderBy("updated_at").offset(20).limit(20)
    assert "TakeOrderedAndProject" in plan_of(rows)


def test_month_partitions_pruned(t):
    p = plan_of(t.notes_created_between("1998-01-01", "1998-03-31").where("status = 'Open'"))
    assert "PartitionFilters: [isnotnull(created_month" in p


def test_per_group_top_k_is_partial_before_shuffle(spark, t):
    from pyspark.sql import Window, functions as F
    w = Window.partitionBy("title").orderBy(F.col("counter").desc(), "id")
    df = t.notes.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    p = plan_of(df)
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("name", ["agent_performance", "notes_page", "title_search_batch", "change_log",
                                  "category_rollup", "clients_page"])
def test_no_python_udf(spark, name):
    df = se.queries()[name](spark, SF_SMALL)
    p = plan_of(df)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p
    assert "CartesianProduct" not in p


def test_aggregates_are_partial_then_final(t):
    p = plan_of(reports.agent_performance(t.notes, t.users))
    assert "partial_count" in p


def test_lookup_fallback_equals_broadcast_path(t):
    from ticketlake.plans.joins import cut_lineage, lookup_for_small
    page = cut_lineage(t.notes.orderBy("id").limit(30))
    a = lookup_for_small(page, "client_id", t.clients, "id", {"name": "client_name"}, bounded=True)
    b = lookup_for_small(page, "client_id", t.clients, "id", {"name": "client_name"}, bounded=False)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_summary_shares_one_grouping(spark, t):
    from ticketlake.operators import exports
    doc = exports.summary_document(t.notes, t.clients, t.users, t.categories)
    assert sorted(map(tuple, doc["totals"].collect())) == sorted(map(tuple, reports.totals(t.notes, t.clients).collect()))
    assert sorted(map(tuple, doc["by_status"].collect())) == sorted(map(tuple, reports.by_status(t.notes).collect()))


def test_page_lookup_is_broadcast_semi_join(t):
    from ticketlake.plans.joins import cut_lineage, lookup_for_small
    page = cut_lineage(t.notes.orderBy("id").limit(20))
    p = plan_of(lookup_for_small(page, "client_id", t.clients, "id", {"name": "client_name"}, bounded=True))
    assert "BroadcastHashJoin" in p and "LeftSemi" in p
    assert "SortMergeJoin" not in p
    assert "GreaterThanOrEqual(id,ScalarSubquery" in p  # key range reaches the dimension scan
