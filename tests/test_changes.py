"""Change job properties: one batch equals two batches applied in order;
the maintained count equals a recount; given NULL wins; deletes end a note."""

from pyspark.sql import functions as F

from ticketlake.operators import changes, quality


def _snapshot(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_batch_equals_two(tables):
    ch = tables.note_changes
    cut = ch.agg(F.percentile_approx("seq", 0.5)).first()[0]
    whole = changes.apply_note_changes(tables.notes, ch, tables.clients)
    first = changes.apply_note_changes(tables.notes, ch.where(F.col("seq") <= cut), tables.clients)
    second = changes.apply_note_changes(first.notes, ch.where(F.col("seq") > cut), tables.clients)
    assert _snapshot(whole.notes) == _snapshot(second.notes)


def test_counts_equal_recount(tables):
    """Stored counts that were right stay right; drifted ones are found, and right after a repair."""
    stored = changes.repaired_counts(tables.clients, tables.notes)
    found = quality.count_drift(tables.clients, tables.notes)
    assert found.count() == stored.where("repaired").count() > 0
    for clients in (stored.drop("repaired"), tables.clients.drop("notes_count")):
        r = changes.apply_note_changes(tables.notes, tables.note_changes, clients)
        assert quality.count_drift(r.client_counts.withColumnRenamed("client_id", "id"), r.notes).count() == 0
    r = changes.apply_note_changes(tables.notes, tables.note_changes, tables.clients)
    assert quality.count_drift(r.client_counts.withColumnRenamed("client_id", "id"), r.notes).count() > 0


def test_count_drift_runs_the_change_job(spark, tables):
    """count_drift checks what the change job maintains, not the tables as they were before it."""
    from tests.conftest import SF_SMALL
    from ticketlake import registry
    got = _snapshot(registry.QUERIES["count_drift"](spark, SF_SMALL))
    r = registry._changed(spark, SF_SMALL)[1]
    n = {x.client_id: x.n for x in r.notes.groupBy("client_id").agg(F.count("*").alias("n")).collect()}
    assert got == sorted((x.client_id, x.notes_count, n.get(x.client_id, 0)) for x in r.client_counts.collect()
                         if x.notes_count != n.get(x.client_id, 0))
    assert got != _snapshot(registry.QUERIES["stored_count_drift"](spark, SF_SMALL))


def test_older_tables_without_the_new_columns_are_read(spark, tables, tmp_path):
    from ticketlake.sources.tables import Tables
    tables.clients.drop("notes_count", "updated_at").write.parquet(str(tmp_path / "clients"))
    tables.activity_logs.drop("target_name").write.parquet(str(tmp_path / "activity_logs"))
    old = Tables(spark, str(tmp_path), derived=False)
    assert old.clients.columns == tables.clients.columns and old.clients.where("notes_count is not null").isEmpty()
    assert old.activity_logs.columns == tables.activity_logs.columns


def test_given_null_wins_and_resolved_at(spark, tables):
    base = tables.notes.where("id in (1, 2)")
    ch = spark.createDataFrame(
        [(1, 1, "patch", "description", None, None, "2001-09-01 00:00:00", None, None),
         (2, 2, "patch", "status", "Resolved", None, "2001-09-02 00:00:00", None, None),
         (3, 2, "increment", None, None, None, "2001-09-03 00:00:00", None, None),
         (4, 2, "delete", None, None, None, "2001-09-04 00:00:00", None, None),
         (5, 2, "increment", None, None, None, "2001-09-05 00:00:00", None, None)],
        "seq long, note_id long, op string, field string, new_value string, client_id long, "
        "changed_at string, title string, agent_id long").withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))
    r = changes.apply_note_changes(base, ch, tables.clients)
    out = {row.id: row for row in r.notes.collect()}
    assert out[1].description is None and str(out[1].updated_at) == "2001-09-01 00:00:00"
    assert 2 not in out  # deleted; the later increment is ignored
    log = {row.id: row for row in r.activity.collect()}
    assert log[3].meta.startswith('{"new_counter":') and 5 not in log


def test_inserts_keep_given_fields(spark, tables):
    """Priority, status, category and description as given; unknown ones are refused."""
    rows = [(1, "High", "Resolved", 3, "text"), (2, None, None, None, " "), (3, "Urgent", None, None, None),
            (4, "Low", "Closed", None, None), (5, "Low", None, 4711, None)]
    ch = spark.createDataFrame(
        [(s, 90_000_000 + s, "insert", None, None, 1, None, "New", 2, 2, p, st, c, d) for s, p, st, c, d in rows],
        "seq long, note_id long, op string, field string, new_value string, client_id long, changed_at timestamp_ntz, "
        "title string, agent_id long, actor_id long, priority string, status string, category_id long, description string")
    r = changes.apply_note_changes(tables.notes.limit(0), ch, tables.clients, tables.categories)
    got = {x.id - 90_000_000: (x.priority, x.status, x.category_id, x.description, x.resolved_at) for x in r.notes.collect()}
    assert got == {1: ("High", "Resolved", 3, "text", None), 2: ("Medium", "Open", None, None, None)}
    assert {x.user_id for x in r.activity.collect()} == {2}


def test_permissions_at_the_time_of_the_change(spark, tables):
    from ticketlake.operators import permissions
    users = spark.createDataFrame([(1, "admin", True), (2, "agent", True), (3, "agent", True), (4, "agent", False)],
                                  "id long, role string, active boolean")
    uch = spark.createDataFrame([(10, 2, "role", "supervisor"), (20, 2, "role", "agent"), (30, 1, "deactivate", None),
                                 (40, 4, "active", "true"), (50, 3, "role", "owner")],
                                "seq long, target_id long, op string, new_value string")
    dec = uch.selectExpr("seq", "op != 'role' or new_value != 'owner' as accepted")
    notes = spark.createDataFrame([(7, 3)], "id long, agent_id long")
    client = tables.clients.first().id
    rows = [(5, 7, "patch", 2, None), (15, 7, "patch", 2, None), (25, 7, "patch", 2, None), (26, 7, "patch", 3, None),
            (27, 7, "delete", 3, None), (28, 7, "delete", 1, None), (31, 7, "patch", 1, None), (35, 8, "insert", 3, "t"),
            (34, 8, "patch", 3, None), (36, 8, "patch", 3, None), (37, 8, "patch", 2, None), (39, 7, "increment", 4, None),
            (41, 7, "increment", 4, None), (42, 7, "increment", 9, None), (43, 99, "patch", 3, None), (44, 7, "patch", None, None),
            (55, 7, "patch", 3, None)]
    ch = spark.createDataFrame([(s, n, op, "description", "x", client, None, t, a, a) for s, n, op, a, t in rows],
                               "seq long, note_id long, op string, field string, new_value string, client_id long, "
                               "changed_at timestamp_ntz, title string, agent_id long, actor_id long")
    d = permissions.note_permissions(notes, ch, tables.clients, tables.categories, users, uch, dec)
    assert {r.seq: r.reason for r in d.collect()} == {
        5: "not_owner", 15: None, 25: "not_owner", 26: None, 27: "forbidden", 28: None, 31: "inactive", 34: "not_owner",
        35: None, 36: None, 37: "not_owner", 39: "inactive", 41: None, 42: "unknown_actor", 43: "not_owner",
        44: "unknown_actor", 55: None}


def test_offers_fold_among_themselves_as_one_by_one(spark, tables):
    import random
    rng = random.Random(11)
    words = ["printer", "Printer jam", "printer jam on floor 2", "100% cpu", "100% CPU load", "a_b c", "a_b C d", "axb c d", "zz", "zz top hat",
             "top hat", "back\\slash", "a back\\slash here"]
    offers = [(s, 80_000_000 + s, rng.choice(words)) for s in range(60)]
    ch = spark.createDataFrame([(s, n, "insert", None, None, 1, None, t, 2) for s, n, t in offers],
                               "seq long, note_id long, op string, field string, new_value string, client_id long, "
                               "changed_at timestamp_ntz, title string, agent_id long")
    known = tables.notes.limit(1).withColumn("title", F.lit("my Top Hat")).withColumn("id", F.lit(5).cast("long"))
    kept, want = [], {}
    for s, n, t in offers:
        low = t.lower()
        if len(t) >= 4 and low in "my top hat":
            want[s] = ("increment", 5)
        elif len(t) >= 4 and (hit := next((m for m, u in kept if low in u), None)):
            want[s] = ("increment", hit)
        else:
            want[s] = ("insert", n)
            kept.append((n, low))
    got = changes.fold_duplicates(known, tables.clients, tables.categories, ch).collect()
    assert {r.seq: (r.decision, r.target_id) for r in got} == want
