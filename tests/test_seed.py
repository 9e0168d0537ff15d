"""Hand-counted results on the tracker's seed rows (FIXTURES.md section 2)."""

import pytest

from tests import seed_data
from ticketlake.operators import lists, reports, tree


@pytest.fixture(scope="module")
def seed(spark):
    return seed_data.load(spark)


def test_by_status_and_priority(seed):
    _, _, _, notes, _ = seed
    assert {r.status: r["count"] for r in reports.by_status(notes).collect()} == \
        {"Open": 4, "In Progress": 3, "Resolved": 3}
    assert {r.priority: r["count"] for r in reports.by_priority(notes).collect()} == \
        {"High": 5, "Medium": 4, "Low": 1}


def test_totals(seed):
    _, clients, _, notes, _ = seed
    t = reports.totals(notes, clients).collect()[0]
    assert (t.total_notes, t.total_clients, t.resolution_rate) == (10, 8, 30.0)
    assert reports.export_summary(notes).collect()[0].total_occurrences == 58


def test_top_issue(seed):
    _, _, cats, notes, _ = seed
    top = reports.top_issues(notes, cats).orderBy("counter", ascending=False).first()
    assert (top.title, top.counter, top.category) == ("Payment failed at checkout", 12, "Payment")


def test_by_category(seed):
    _, _, cats, notes, _ = seed
    got = {r.name: (r["count"], r.total_occurrences) for r in reports.by_category(notes, cats).collect()}
    assert got == {"Product Quality": (3, 11), "Payment": (3, 23), "Technical Support": (2, 15),
                   "Delivery": (1, 7), "Billing": (1, 2)}


def test_agents(seed):
    users, _, _, notes, _ = seed
    got = {r.agent_name: (r.total_notes, r.resolved, r.resolution_rate, r.avg_hours_to_resolve)
           for r in reports.agent_performance(notes, users).collect()}
    assert got == {"Aisha Patel": (5, 1, 20.0, None), "Tom Rivera": (3, 1, 33.3, None),
                   "Lily Nguyen": (2, 1, 50.0, None)}


def test_rollup_equals_direct_on_children(seed):
    # seed notes are tagged on roots only, so the roll-up equals the direct report
    _, _, cats, notes, _ = seed
    spark = notes.sparkSession
    got = {r.name: r["count"] for r in tree.category_rollup(cats, notes).collect()}
    assert got["Payment"] == 3 and got["Billing"] == 1


def test_activity_labels(seed):
    users, _, _, _, activity = seed
    rows = lists.activity_meta(activity, users, seed_data.AS_OF).orderBy("id").collect()
    assert [r.age for r in rows] == ["5m ago", "1h ago", "3h ago", "5h ago", "1d ago", "2d ago", "3d ago", "4d ago"]
    assert rows[2].action_label == "Resolved note" and rows[2].user_label == "Sarah Chen"
