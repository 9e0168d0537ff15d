
import datetime as dt

from pyspark.sql import functions as F

from ticketlake import schemas
from ticketlake.functions import expressions as E
from ticketlake.operators import changes, lists, reports
from ticketlake.operators.filters import NoteQuery


def _notes(spark, rows):
    base = dt.datetime(2024, 1, 10, 15, 0)
    data = [(i, 1, agent, None, title, desc, "Low", status, 1, None, base + dt.timedelta(hours=h), base)
            for i, agent, title, desc, status, h in rows]
    return spark.createDataFrame(data, schemas.NOTES)


def test_bare_date_to_excludes_rest_of_day(spark):
    n = _notes(spark, [(1, 3, "a", None, "Open", 0), (2, 3, "b", None, "Open", -20)])
    got = n.where(NoteQuery(date_to="2024-01-10").predicate()).select("id").collect()
    assert [r.id for r in got] == [2]  # 15:00 on the 10th is after 2024-01-10 00:00


def test_search_text_is_not_escaped(spark):
    n = _notes(spark, [(1, 3, "100% done", None, "Open", 0), (2, 3, "1000 dollars", None, "Open", 0),
                       (3, 3, "a_b", None, "Open", 0), (4, 3, "axb", None, "Open", 0)])
    pct = {r.id for r in n.where(NoteQuery(q="100%").predicate()).collect()}
    under = {r.id for r in n.where(NoteQuery(q="a_b").predicate()).collect()}
    assert pct == {1, 2} and under == {3, 4}


def test_agent_scope_is_anded_with_agent_filter(spark):
    n = _notes(spark, [(1, 3, "a", None, "Open", 0), (2, 4, "b", None, "Open", 0)])
    q = NoteQuery(role="agent", user_id=3, agent_id=4)
    assert n.where(q.predicate()).count() == 0
    assert n.where(NoteQuery(role="supervisor", user_id=3, agent_id=4).predicate()).count() == 1


def test_blank_filters_are_ignored(spark):
    n = _notes(spark, [(1, 3, "a", None, "Open", 0), (2, 4, "b", None, "Resolved", 0)])
    assert n.where(NoteQuery(status=" ", priority="").predicate()).count() == 2


def test_rate_rounding_and_empty(spark):
    empty = _notes(spark, [(1, 3, "a", None, "Open", 0)]).where("false")
    clients = spark.createDataFrame([], schemas.CLIENTS)
    t = reports.totals(empty, clients).first()
    assert t.total_notes == 0 and t.resolution_rate is None and t.total_clients == 0
    assert reports.report_counts(empty).first().resolution_rate_pct == 0


def test_created_resolved_has_no_resolved_at_and_defaults(spark, tables):
    ch = spark.createDataFrame(
        [(1, 99_000_001, "insert", None, None, 1, dt.datetime(2001, 9, 1), "New thing", 2)],
        "seq long, note_id long, op string, field string, new_value string, client_id long, "
        "changed_at timestamp_ntz, title string, agent_id long")
    r = changes.apply_note_changes(tables.notes.limit(0), ch, tables.clients)
    row = r.notes.first()
    assert (row.priority, row.status, row.counter, row.resolved_at) == ("Medium", "Open", 1, None)


def test_ui_helpers(spark):
    df = spark.createDataFrame([("Open", "Aisha Patel"), ("Resolved", "Tom"), ("Odd", None)], "s string, n string")
    rows = df.select(E.next_status(F.col("s")).alias("x"), E.initials(F.col("n")).alias("i"),
                     E.title_case_snake(F.lit("total_occurrences")).alias("t")).collect()
    assert [(r.x, r.i) for r in rows] == [("In Progress", "AP"), ("Open", "T"), ("Open", "?")]
    assert rows[0].t == "Total Occurrences"


def test_client_list_counts_fresh(spark, tables):
    page = lists.clients_page(tables.clients, tables.notes, None, __import__(
        "ticketlake.functions.paging", fromlist=["paginate"]).paginate(1, 5))
    for r in page.collect():
        assert r.notes_count == tables.notes.where(F.col("client_id") == r.id).count()


def test_rate_is_numeric_division(spark):
    df = spark.createDataFrame([(23, 80), (0, 0), (1, 3)], "p long, w long")
    assert [r.x for r in df.select(E.pct_rounded(F.col("p"), F.col("w")).alias("x")).collect()] == [28.8, None, 33.3]


def test_backslash_in_searches(spark):
    """A backslash makes the next character plain, wherever it stands."""
    from ticketlake.operators.filters import like_pattern
    from ticketlake.operators.search import title_search, title_search_batch
    titles = ["100% sure", "100 percent", "back\\slash", "a_b", "axb", "%%%", "plain"]
    notes = spark.createDataFrame([(i, t, 1, "Open", "Low", 1, None) for i, t in enumerate(titles)],
                                  "id long, title string, counter int, status string, priority string, client_id long, category_id long")
    dims = spark.createDataFrame([(1, "x")], "id long, name string")
    want = {"100\\%": [0], "k\\\\s": [2], "a\\_b": [3], "a_b": [3, 4], "\\%\\%\\%": [5], "pl\\ain": [6], "100%": [0, 1], "zzz\\": []}
    for q, ids in want.items():
        assert sorted(r.id for r in title_search(notes, dims, dims, q).collect()) == ids, q
    cands = spark.createDataFrame(list(enumerate(want)), "cand_id long, q string")
    got = title_search_batch(notes, dims, dims, cands).collect()
    assert {q: sorted(r.id for r in got if r.q == q) for q in want} == want


def test_reports_are_sorted(spark, tables):
    from ticketlake.operators import reports
    for df, key, down in ((reports.by_category(tables.notes, tables.categories), "count", True),
                          (reports.agent_performance(tables.notes, tables.users), "total_notes", True),
                          (reports.notes_per_agent(tables.notes, tables.users), "notes", True),
                          (reports.trend(tables.notes, "2001-08-01"), "period", False)):
        values = [r[key] for r in df.collect()]
        assert values == sorted(values, reverse=down) and values


def test_broken_rows_break_every_rule(spark):
    from ticketlake import registry
    rules = {(r.rule, r.table_name) for r in registry.QUERIES["broken_rows"](spark, "/root/testdata/sf0.01").collect()}
    assert {"orphan_client", "orphan_category", "orphan_parent", "orphan_log_user", "orphan_inviter", "unique_email", "unique_phone",
            "domain_role", "domain_priority", "domain_status", "blank_name", "blank_action", "too_long_title", "too_long_company",
            "too_long_action", "missing_agent_id", "counter_min", "email_form", "email_not_normalized"} <= {r for r, _ in rules}


def test_a_cluster_needs_a_shared_folder(spark):
    import pytest
    from ticketlake.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_a_rewritten_part_file_is_seen(spark, tmp_path):
    import shutil

    from ticketlake.sources.tables import _fingerprint
    spark.range(5).repartition(2).write.parquet(str(tmp_path / "orders.parquet"))
    before = _fingerprint(spark, str(tmp_path))
    assert before == _fingerprint(spark, str(tmp_path))
    part = next((tmp_path / "orders.parquet").glob("part-*"))
    shutil.copy(part, part.with_name("part-99999.parquet"))
    assert before != _fingerprint(spark, str(tmp_path))
