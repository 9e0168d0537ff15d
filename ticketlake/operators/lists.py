"""Lists, pages, detail and history views (K1-K3, K10, J1-J6, J10, J13, J14,
A1, A13, A15, A17, F13, W13 states, E14, E19, E20, E27).

Plan shape: filters first (pushed to the scan), then a bounded top-k
(``TakeOrderedAndProject`` of offset+limit rows, no global sort), then the
dimension lookups for the page rows only (``lookup_for_small``). Counts run on
the fact table alone, without the joins. Per-key aggregates for a page are
computed only for the page's keys (semi join with the bounded key set).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import expressions as E
from ticketlake.functions.paging import Page, page_meta, take_page
from ticketlake.operators.filters import NoteQuery, client_search, key_equals, pending_invitation
from ticketlake.plans.joins import cut_lineage, lookup_for_small, within_broadcast_bound

def NOTE_ORDER():
    return [F.col("updated_at").desc(), F.col("id").desc()]


def enrich_notes(page: DataFrame, clients: DataFrame, users: DataFrame, categories: DataFrame,
                 agent_email: bool = False) -> DataFrame:
    """J1 / J3 on a bounded set of notes: client name and phone, agent name
    (and e-mail), category name. The page is computed once."""
    page = cut_lineage(page)
    b = within_broadcast_bound(page)
    out = lookup_for_small(page, "client_id", clients, "id", {"name": "client_name", "phone": "client_phone"}, b)
    ucols = {"name": "agent_name"}
    if agent_email:
        ucols["email"] = "agent_email"
    out = lookup_for_small(out, "agent_id", users, "id", ucols, b)
    return lookup_for_small(out, "category_id", categories, "id", {"name": "category_name"}, b)


# K3 + F1-F7 + J1 --------------------------------------------------------------
def notes_page(notes, clients, users, categories, query: NoteQuery, page: Page) -> DataFrame:
    rows = take_page(notes.where(query.predicate()), NOTE_ORDER(), page)
    return enrich_notes(rows, clients, users, categories)


# A1 + K2 ----------------------------------------------------------------------
def notes_count(notes: DataFrame, query: NoteQuery) -> DataFrame:
    return notes.where(query.predicate()).agg(F.count(F.lit(1)).cast("bigint").alias("total"))


def notes_page_meta(notes: DataFrame, query: NoteQuery, page: Page) -> DataFrame:
    return page_meta(notes_count(notes, query), page)


# K1 ---------------------------------------------------------------------------
def after_key(updated_at, note_id):
    """Rows strictly after (updated_at, id) in the list order (both DESC)."""
    u = updated_at if not isinstance(updated_at, str) else E.lit_ts(updated_at)
    return (F.col("updated_at") < u) | ((F.col("updated_at") == u) & (F.col("id") < note_id))


def notes_after_key(notes, clients, users, categories, query: NoteQuery, updated_at, note_id,
                    limit: int) -> DataFrame:
    """Keyset page: no deep offset, the key predicate prunes row groups."""
    rows = (notes.where(query.predicate() & after_key(updated_at, note_id))
            .orderBy(*NOTE_ORDER()).limit(limit))
    return enrich_notes(rows, clients, users, categories)


def last_key_of(page_rows: DataFrame):
    """(updated_at, id) of the last row of a page, as scalar subqueries."""
    last = page_rows.select(F.min(F.struct("updated_at", "id")).alias("k"))
    return last.select("k.updated_at").scalar(), last.select("k.id").scalar()


# F14 + J3 ---------------------------------------------------------------------
def note_detail(notes, clients, users, categories, note_id: int) -> DataFrame:
    rows = notes.where(key_equals("id", int(note_id)))
    return enrich_notes(rows, clients, users, categories, agent_email=True)


def notes_detail_batch(notes, clients, users, categories, ids: DataFrame) -> DataFrame:
    """F14 for many keys: semi join of the notes with a key set ``ids(id)``;
    dimensions are joined by the planner (sizes measured)."""
    rows = notes.join(ids.select("id").distinct(), "id", "left_semi")
    out = rows
    for dim, key, cols in ((clients, "client_id", {"name": "client_name", "phone": "client_phone"}),
                           (users, "agent_id", {"name": "agent_name", "email": "agent_email"}),
                           (categories, "category_id", {"name": "category_name"})):
        proj = dim.select(F.col("id").alias("__dk"), *[F.col(c).alias(a) for c, a in cols.items()])
        out = out.join(proj, F.col(key) == F.col("__dk"), "left").drop("__dk")
    return out


# J6, K10 ----------------------------------------------------------------------
def client_history(notes, users, categories, client_id: int) -> DataFrame:
    """All notes of one client, newest change first, with category and agent
    names. Not bounded: dimensions are joined by measured size, and the sort
    is a distributed range sort."""
    rows = notes.where(key_equals("client_id", int(client_id)))
    cats = categories.select(F.col("id").alias("__cid"), F.col("name").alias("category_name"))
    ags = users.select(F.col("id").alias("__uid"), F.col("name").alias("agent_name"))
    return (rows.join(cats, F.col("category_id") == F.col("__cid"), "left")
            .join(ags, F.col("agent_id") == F.col("__uid"), "left")
            .drop("__cid", "__uid")
            .orderBy(*NOTE_ORDER()))


# S13 (re-aimed: the children stay rows) ---------------------------------------
def client_document(clients, notes, client_id: int) -> DataFrame:
    """The client row with the size of its notes list and its last activity.
    The notes themselves are ``client_history`` rows: a client's notes are an
    unbounded group and are never packed into one array."""
    c = clients.where(key_equals("id", int(client_id)))
    n = (notes.where(key_equals("client_id", int(client_id)))
         .agg(F.count(F.lit(1)).cast("bigint").alias("notes_count"),
              F.max("updated_at").alias("last_activity")))
    return c.drop("notes_count").select("*", n.select("notes_count").scalar().alias("notes_count"),
                    n.select("last_activity").scalar().alias("last_activity"))


# F4, F9, J5, A13, K3 ----------------------------------------------------------
def CLIENT_ORDER():
    return [F.col("created_at").desc(), F.col("id").desc()]


def clients_page(clients, notes, q: str | None, page: Page) -> DataFrame:
    """Active clients (optionally matching q), newest first, with a fresh
    distinct note count and last note update; the stored count is not used.
    Notes are aggregated for the page's clients only."""
    rows = cut_lineage(take_page(clients.where(client_search(q)), CLIENT_ORDER(), page))
    keys = rows.select(F.col("id").alias("client_id"))  # <= 100 rows (a page), checked
    agg = (notes.join(F.broadcast(keys) if within_broadcast_bound(rows) else keys, "client_id", "left_semi")
           .groupBy("client_id")
           .agg(F.count_distinct("id").cast("bigint").alias("notes_count"),
                F.max("updated_at").alias("last_activity")))
    # a stored notes_count is replaced by the fresh count, never duplicated
    keep = [rows[c] for c in rows.columns if c not in ("notes_count", "last_activity")]
    return (rows.join(agg, rows["id"] == agg["client_id"], "left")
            .select(*keep, F.coalesce(agg["notes_count"], F.lit(0)).cast("bigint").alias("notes_count"),
                    agg["last_activity"]))


def clients_page_meta(clients, q: str | None, page: Page) -> DataFrame:
    cnt = clients.where(client_search(q)).agg(F.count(F.lit(1)).cast("bigint").alias("total"))
    return page_meta(cnt, page)


# J10, A15 ---------------------------------------------------------------------
def USER_ORDER():
    return [F.col("created_at").desc(), F.col("id").desc()]


def users_page(users, notes, page: Page) -> DataFrame:
    """Users (no password) with their note count, newest first."""
    rows = cut_lineage(take_page(users.select("id", "name", "email", "role", "active", "created_at"),
                                 USER_ORDER(), page))
    keys = rows.select(F.col("id").alias("agent_id"))  # <= 100 rows (a page), checked
    agg = (notes.join(F.broadcast(keys) if within_broadcast_bound(rows) else keys, "agent_id", "left_semi")
           .groupBy("agent_id").agg(F.count(F.lit(1)).cast("bigint").alias("notes_count")))
    return (rows.join(agg, rows["id"] == agg["agent_id"], "left")
            .select(*[rows[c] for c in rows.columns],
                    F.coalesce(agg["notes_count"], F.lit(0)).cast("bigint").alias("notes_count"),
                    E.active_label(rows["active"]).alias("active_label"),
                    E.initials(rows["name"]).alias("initials")))


# A17 --------------------------------------------------------------------------
def setup_flag(users) -> DataFrame:
    """Whether any admin exists (public sign-up is open only when none does)."""
    return (users.agg(F.count_if(F.col("role") == "admin").cast("bigint").alias("admin_count"))
            .select("admin_count", (F.col("admin_count") > 0).alias("admins_exist")))


# J13, E14, E19, E20, E27, K3 --------------------------------------------------
def ACTIVITY_ORDER():
    return [F.col("created_at").desc(), F.col("id").desc()]


def _activity_labels(df: DataFrame, as_of) -> DataFrame:
    return df.select("*",
                     E.user_label(F.col("user_name")).alias("user_label"),
                     E.action_label(F.col("action")).alias("action_label"),
                     E.relative_age(F.col("created_at"), E.lit_ts(as_of)).alias("age"))


def activity_page(activity, users, page: Page, as_of) -> DataFrame:
    rows = cut_lineage(take_page(activity, ACTIVITY_ORDER(), page))
    rows = lookup_for_small(rows, "user_id", users, "id", {"name": "user_name", "role": "user_role"})
    return _activity_labels(rows, as_of)


def activity_meta(activity, users, as_of) -> DataFrame:
    """Whole feed with display labels and the JSON meta read back."""
    u = users.select(F.col("id").alias("__uid"), F.col("name").alias("user_name"),
                     F.col("role").alias("user_role"))
    j = activity.join(u, F.col("user_id") == F.col("__uid"), "left").drop("__uid")
    out = _activity_labels(j, as_of)
    return out.select("id", "user_id", "action", "user_label", "action_label", "age",
                      F.get_json_object("meta", "$.k").cast("bigint").alias("meta_k"),
                      F.get_json_object("meta", "$.new_counter").cast("bigint").alias("meta_new_counter"),
                      F.to_json(F.struct(F.col("action"), F.col("target_id"))).alias("meta_json"))


# F13, J14, K10 ----------------------------------------------------------------
def invitations_pending(invitations, users, as_of) -> DataFrame:
    inv = invitations.where(pending_invitation(as_of))
    u = users.select(F.col("id").alias("__uid"), F.col("name").alias("created_by_name"))
    return (inv.join(u, F.col("created_by") == F.col("__uid"), "left").drop("__uid")
            .orderBy(F.col("created_at").desc(), F.col("id").desc()))


# E23 with the time -------------------------------------------------------------
def invitations_display(invitations, as_of) -> DataFrame:
    """The invitation list as shown: who, which role, sent when, state."""
    return invitations.select("id", "email", E.title_case_snake(F.col("role")).alias("role_label"),
                              E.datetime_string(F.col("created_at")).alias("sent"),
                              E.datetime_string(F.col("expires_at")).alias("expires"),
                              invitation_state(as_of).alias("state"))


# E27 ----------------------------------------------------------------------------
def changed_fields(activity) -> DataFrame:
    """The meta of update rows read back: one row per changed field, in order."""
    meta = F.from_json("meta", "changes array<string>")
    return (activity.where(F.col("action") == "update_note")
            .select("id", F.col("target_id").alias("note_id"), F.posexplode(meta["changes"]).alias("position", "field"))
            .withColumn("position", F.col("position").cast("bigint")))


# W13 states -------------------------------------------------------------------
def invitation_state(as_of):
    return (F.when(F.col("used_at").isNotNull(), "used")
            .when(F.col("expires_at") <= E.lit_ts(as_of), "expired").otherwise("pending"))


def invitation_states(invitations, as_of) -> DataFrame:
    return invitations.select("id", "email", "role", invitation_state(as_of).alias("state"))


# E9, E13, E21, E23, E24 -------------------------------------------------------
def notes_display(notes, clients, users, categories, page: Page) -> DataFrame:
    """A page of notes with the screen's derived values: the next status of
    the status button, the agent's initials and first name, the created date
    and month label, and an empty description shown as missing."""
    rows = notes_page(notes, clients, users, categories, NoteQuery(), page)
    return rows.select("id", "status", "agent_name",
                       E.next_status(F.col("status")).alias("next_status"),
                       E.initials(F.col("agent_name")).alias("agent_initials"),
                       E.first_name(F.col("agent_name")).alias("agent_first_name"),
                       E.date_string(F.col("created_at")).alias("created_date"),
                       E.period_label(F.col("created_at"), with_year=True).alias("created_month"),
                       E.blank_to_null(F.col("description")).alias("description"))
