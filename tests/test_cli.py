import os

from tests.conftest import SF_SMALL
from ticketlake import cli
from ticketlake.session import scratch_dir


def test_cli_run_writes_result(spark, tables):
    out = os.path.join(scratch_dir(spark, "test-cli"), "agents")
    assert cli.main(["run", "agent_performance", SF_SMALL, out]) == 0
    assert spark.read.parquet(out).count() == tables.users.where("role = 'agent'").count()


def test_month_partition_filter_keeps_boundaries(tables):
    lo, hi = "1997-03-15 10:00:00", "1997-05-01 00:00:00"
    pruned = tables.notes_created_between(lo, hi).where(f"created_at >= '{lo}' AND created_at <= '{hi}'")
    full = tables.notes.where(f"created_at >= '{lo}' AND created_at <= '{hi}'")
    assert sorted(r.id for r in pruned.collect()) == sorted(r.id for r in full.collect())
