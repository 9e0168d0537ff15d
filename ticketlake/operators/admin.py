"""Client, user, category and invitation write rules as
batch jobs over change sets.

Shared shape (as the note job): changes ``(seq, target_id, field, new_value,
changed_at, ...)`` are validated, joined to the snapshot (a change to a
missing row is ignored), folded per key with partial aggregation (max of
``(seq, value)`` structs: the last given value wins, a given NULL included),
and joined once to the snapshot. ``updated_at`` is touched by every applied
change (W11). Derived tables have no stored ``updated_at`` for users and
clients; it starts as ``created_at``.

The change sets registered for checking are derived from the given tables
(``*_changes_from_*`` below); on a real deployment they are the request log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlake import schemas
from ticketlake.functions import expressions as E
from ticketlake.functions.expressions import lit_ts
from ticketlake.plans.joins import cut_lineage
from ticketlake.plans.prefix import running


def fold_fields(base: DataFrame, changes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Apply validated field changes ``(seq, target_id, field, new_value,
    changed_at)`` to ``base`` (key ``id``): last given value per field, cast
    to the field's type; ``updated_at`` = time of the last applied change."""
    aggs = [F.max(F.struct("seq", "changed_at")).alias("__last")]
    for f in fields:
        aggs.append(F.max(F.when(F.col("field") == f, F.struct("seq", "new_value"))).alias(f"__p_{f}"))
    folded = changes.groupBy("target_id").agg(*aggs)
    j = base.join(folded, F.col("id") == F.col("target_id"), "left")
    cols = []
    for c in base.columns:
        if c in fields:
            v = F.col(f"__p_{c}.new_value")
            v = v.try_cast(fields[c]) if fields[c] != "string" else v
            cols.append(F.when(F.col(f"__p_{c}").isNotNull(), v).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.coalesce(F.col("__last.changed_at"), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def _with_updated(df: DataFrame) -> DataFrame:
    return df if "updated_at" in df.columns else df.withColumn("updated_at", F.col("created_at"))


# Users ----------------------------------------------------------------
USER_FIELDS = {"name": "string", "role": "string", "active": "boolean"}


def user_changes_from_events(events: DataFrame) -> DataFrame:
    """Admin requests on users from signup events: op by event_id mod 4 --
    deactivate, rename, change role, set active; the acting admin is user
    (event_id mod 5) * 20."""
    eid = F.col("event_id")
    op = F.element_at(F.array(F.lit("deactivate"), F.lit("name"), F.lit("role"), F.lit("active")),
                      (eid % 4 + 1).cast("int"))
    value = (F.when(eid % 4 == 1, F.concat(F.lit("Agent "), eid.cast("string")))
             .when(eid % 4 == 2, F.element_at(F.array(*[F.lit(r) for r in schemas.ROLES]), (eid % 3 + 1).cast("int")))
             .when(eid % 4 == 3, F.when(eid % 2 == 0, "true").otherwise("false")))
    return events.where(F.col("event_type") == "signup").select(
        eid.cast("bigint").alias("seq"), F.col("user_id").cast("bigint").alias("target_id"),
        op.alias("op"), value.alias("new_value"), ((eid % 5) * 20).cast("bigint").alias("actor_id"),
        F.col("ts").cast("timestamp_ntz").alias("changed_at"))


def apply_user_changes(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (new users, decisions). Deactivation of one's own account is
    refused; a role outside the domain is refused; a missing user is 404."""
    exists = users.select(F.col("id").alias("__uid"))
    c = changes.join(exists, F.col("target_id") == F.col("__uid"), "left").withColumn(
        "reason",
        F.when(F.col("__uid").isNull(), "not_found")
         .when((F.col("op") == "deactivate") & (F.col("target_id") == F.col("actor_id")), "own_account")
         .when((F.col("op") == "role") & ~F.col("new_value").isin(*schemas.ROLES), "bad_role")
         .when((F.col("op") == "name") & (F.col("new_value").isNull() | (F.trim("new_value") == "")), "blank_name"))
    decisions = c.select("seq", "target_id", "op", F.col("reason").isNull().alias("accepted"), "reason")
    ok = (c.where(F.col("reason").isNull())
          .select("seq", "target_id",
                  F.when(F.col("op") == "deactivate", "active").otherwise(F.col("op")).alias("field"),
                  F.when(F.col("op") == "deactivate", "false").otherwise(F.col("new_value")).alias("new_value"),
                  "changed_at"))
    return fold_fields(_with_updated(users), ok, USER_FIELDS), decisions


# Clients --------------------------------------------------------------
CLIENT_FIELDS = {"name": "string", "phone": "string", "email": "string", "company": "string", "active": "boolean"}


def client_changes_from_events(events: DataFrame) -> DataFrame:
    """Client requests from purchase events: op by event_id mod 3 -- insert a
    new client (id 20,000,000 + event_id), change the phone of client
    user_id, deactivate client user_id. Phones are '+1-555-' and a 7-digit
    number from event_id mod 2000, so some collide with existing ones."""
    eid = F.col("event_id")
    phone = F.concat(F.lit("+1-555-"), F.lpad((eid % 2000).cast("string"), 7, "0"))
    op = F.element_at(F.array(F.lit("insert"), F.lit("phone"), F.lit("deactivate")), (eid % 3 + 1).cast("int"))
    return events.where(F.col("event_type") == "purchase").select(
        eid.cast("bigint").alias("seq"),
        F.when(eid % 3 == 0, eid + 20000000).otherwise(F.col("user_id")).cast("bigint").alias("target_id"),
        op.alias("op"),
        F.when(eid % 3 == 0, F.concat(F.lit("Client "), eid.cast("string"))).alias("name"),
        F.when(eid % 3 != 2, phone).alias("phone"),
        F.when(eid % 3 == 0, F.concat(F.lit("new"), eid.cast("string"), F.lit("@example.com"))).alias("email"),
        ((eid % 5) * 20).cast("bigint").alias("actor_id"), F.col("ts").cast("timestamp_ntz").alias("changed_at"))


def client_decisions(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes with ``reason`` (null: accepted), as if they came one by one
    in the order of seq: inserts of an existing id, changes of a client that
    isn't there yet, blank names, and phones that another client holds at that
    moment are refused; a phone is free again once its holder has another.

    A decision depends on earlier ones only, so deciding all from the last
    round's acceptances is right for one more change at least in every round
    and ends when a round changes nothing. The first guess is that nobody gives
    up a phone: one that is held stays with its holder, any other goes to its
    first claimant. So the rounds are as many as phones are handed on in a row,
    not as many as claims wait for each other. They see only the columns of the
    claims; the whole changes are decided once, from what the rounds ended with."""
    there = clients.select(F.col("id").alias("target_id"), F.lit(True).alias("__there"))
    c = changes.join(there, "target_id", "left")
    insert = F.col("op") == "insert"
    blank = (insert | (F.col("op") == "name")) & ~E.not_blank(F.coalesce("name", F.lit("")))
    c = cut_lineage(c.withColumn("__there", F.coalesce("__there", F.lit(False))).withColumn("__blank", blank)
                    .withColumn("__sets", F.col("phone").isNotNull() & F.col("op").isin("insert", "phone")))
    claims = c.where(F.col("__sets") | insert).select("seq", "target_id", "op", "phone", "__there", "__blank", "__sets")
    asked = c.where("__sets").select("phone").distinct()
    held = cut_lineage(clients.join(asked, "phone", "left_semi")
                       .select(F.lit(-1).cast("bigint").alias("start"), F.col("id").alias("client"), "phone"))
    valid = claims.where(~F.col("__blank") & (insert != F.col("__there")))
    first = valid.where("__sets").groupBy("phone").agg(F.min(F.struct("seq", "target_id")).alias("__first"))
    owner = (first.join(held.groupBy("phone").agg(F.max("client").alias("__holder")), "phone", "left")
             .select("phone", F.coalesce("__holder", "__first.target_id").alias("__owner")))
    ok = valid.join(owner, "phone", "left").where(~F.col("__sets") | (F.col("target_id") == F.col("__owner")))
    before = None
    while True:
        d = cut_lineage(_client_reasons(claims, ok, held))
        now = d.agg(F.count("reason").alias("n"), F.sum(F.hash("seq", "reason").cast("bigint")).alias("h")).first()
        ok = d.where(F.col("reason").isNull())
        if now == before:
            return cut_lineage(_client_reasons(c, ok, held))
        before = now


def _client_reasons(c: DataFrame, ok: DataFrame, held: DataFrame) -> DataFrame:
    """The changes ``c`` with the ``reason`` that each has if ``ok`` are the accepted ones."""
    insert = F.col("op") == "insert"
    born = ok.where(insert).groupBy("target_id").agg(F.min("seq").alias("__born"))
    sets = ok.where("__sets")
    claims = held.unionByName(sets.select(F.col("seq").alias("start"), F.col("target_id").alias("client"), "phone"))
    # a client's claims follow one another; its snapshot phone ends with its first new one
    moves = sets.groupBy(F.col("target_id").alias("client")).agg(F.min("seq").alias("__first"))
    own = Window.partitionBy("client").orderBy("start")
    claims = (claims.join(moves, "client", "left")
              .withColumn("until", F.when(F.col("start") < 0, F.col("__first"))
                          .otherwise(F.lead("start").over(own))))
    claim = F.struct("start", "client", "until")
    rows = (claims.select("phone", (F.col("start") * 2 + 1).alias("at"), claim.alias("v"), F.lit(None).cast("bigint").alias("seq"))
            .unionByName(c.where("__sets").select("phone", (F.col("seq") * 2).alias("at"),
                                                  F.lit(None).cast("struct<start:bigint,client:bigint,until:bigint>").alias("v"), "seq")))
    last = running(rows, "phone", "at", "v", "__last", how="max").where(F.col("seq").isNotNull()).select("seq", "__last")
    j = c.join(born, "target_id", "left").join(last, "seq", "left")
    exists = F.col("__there") | F.coalesce(F.col("__born") < F.col("seq"), F.lit(False))
    busy = (F.col("__last.client") != F.col("target_id")) & (
        F.col("__last.until").isNull() | (F.col("__last.until") > F.col("seq")))
    return j.withColumn("reason", F.when(insert & exists, "id_exists").when(~insert & ~exists, "not_found")
                        .when(F.col("__blank"), "blank_name").when(busy, "phone_exists")).drop("__born", "__last")


def apply_client_changes(clients: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (new clients, decisions). Operations: insert, deactivate, and a
    change of name, phone, email or company to the column of that name."""
    if "company" not in changes.columns:
        changes = changes.withColumn("company", F.lit(None).cast("string"))
    changes = changes.withColumn("email", E.clean_email(F.col("email")))
    c = client_decisions(clients, changes)
    decisions = c.select("seq", "target_id", "op", F.col("reason").isNull().alias("accepted"), "reason")
    ok = c.where(F.col("reason").isNull())
    new = (ok.where(F.col("op") == "insert")
           .select(F.col("target_id").alias("id"), "name", "phone", "email", "company",
                   F.lit(True).alias("active"), F.col("changed_at").alias("created_at"),
                   F.col("changed_at").alias("updated_at"), F.lit(0).cast("int").alias("notes_count")))
    base = _with_updated(clients)
    base = base.unionByName(new.select(*base.columns))
    value = F.when(F.col("op") == "deactivate", "false")
    for f in ("name", "phone", "email", "company"):
        value = value.when(F.col("op") == f, F.col(f))
    patches = (ok.where(F.col("op") != "insert")
               .select("seq", "target_id",
                       F.when(F.col("op") == "deactivate", "active").otherwise(F.col("op")).alias("field"),
                       value.alias("new_value"), "changed_at"))
    return fold_fields(base, patches, CLIENT_FIELDS), decisions


# Foreign-key actions -----------------------------------------------------
def fk_actions(notes: DataFrame, categories: DataFrame, activity: DataFrame, invitations: DataFrame,
               removed_clients: DataFrame, removed_users: DataFrame, removed_categories: DataFrame) -> dict:
    """Hard removal of rows and what the references do: a removed client's
    notes go (CASCADE); a user with notes cannot be removed (RESTRICT),
    otherwise log rows and invitations keep NULL; a removed category leaves
    NULL on its notes and children (SET NULL)."""
    rc = removed_clients.select(F.col("id").alias("__rc")).distinct()
    ru = removed_users.select(F.col("id").alias("__ru")).distinct()
    rk = removed_categories.select(F.col("id").alias("__rk")).distinct()
    restricted = ru.join(notes.select(F.col("agent_id").alias("__ru")).distinct(), "__ru", "left_semi")
    ru_ok = ru.join(restricted, "__ru", "left_anti")
    new_notes = notes.join(rc, F.col("client_id") == F.col("__rc"), "left_anti")
    new_notes = (new_notes.join(rk, F.col("category_id") == F.col("__rk"), "left")
                 .withColumn("category_id", F.when(F.col("__rk").isNotNull(), F.lit(None).cast("bigint"))
                             .otherwise(F.col("category_id"))).drop("__rk"))
    new_cats = (categories.join(rk, F.col("id") == F.col("__rk"), "left_anti")
                .join(rk, F.col("parent_id") == F.col("__rk"), "left")
                .withColumn("parent_id", F.when(F.col("__rk").isNotNull(), F.lit(None).cast("bigint"))
                            .otherwise(F.col("parent_id"))).drop("__rk"))

    def null_user(df, col):
        return (df.join(ru_ok, F.col(col) == F.col("__ru"), "left")
                .withColumn(col, F.when(F.col("__ru").isNotNull(), F.lit(None).cast("bigint")).otherwise(F.col(col)))
                .drop("__ru"))
    return {"notes": new_notes, "categories": new_cats, "activity_logs": null_user(activity, "user_id"),
            "invitations": null_user(invitations, "created_by"),
            "restricted_users": restricted.select(F.col("__ru").alias("id"))}


def fk_summary(result: dict) -> DataFrame:
    """One row per outcome for the registered check."""
    n = result["notes"]
    return (n.agg(F.count(F.lit(1)).cast("bigint").alias("notes_left"),
                  F.count_if(F.col("category_id").isNull()).cast("bigint").alias("notes_without_category"))
            .select("*",
                    result["categories"].select(F.count_if(F.col("parent_id").isNull()).cast("bigint")).scalar()
                    .alias("root_categories"),
                    result["activity_logs"].select(F.count_if(F.col("user_id").isNull()).cast("bigint")).scalar()
                    .alias("logs_without_user"),
                    result["invitations"].select(F.count_if(F.col("created_by").isNull()).cast("bigint")).scalar()
                    .alias("invitations_without_inviter"),
                    result["restricted_users"].select(F.count(F.lit(1)).cast("bigint")).scalar()
                    .alias("restricted_users")))


def fk_rows(result: dict) -> DataFrame:
    """Every row that is left, with its reference: (table_name, id, ref)."""
    refs = {"notes": "category_id", "categories": "parent_id", "activity_logs": "user_id", "invitations": "created_by"}
    out = result["restricted_users"].select(F.lit("restricted_users").alias("table_name"), "id", F.lit(None).cast("bigint").alias("ref"))
    for table, ref in refs.items():
        out = out.unionByName(result[table].select(F.lit(table).alias("table_name"), "id", F.col(ref).alias("ref")))
    return out


# Invitation lifecycle ----------------------------------------------------
def cancellations_from_invitations(invitations: DataFrame) -> DataFrame:
    """Cancel requests: every invitation whose id is a multiple of 7, two days
    after it was created."""
    return invitations.where(F.col("id") % 7 == 0).select(
        F.col("id").alias("invitation_id"), (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("cancel_at"))


def invitation_lifecycle(invitations: DataFrame, cancels: DataFrame, as_of) -> DataFrame:
    """State of every invitation at ``as_of`` after the cancel requests: a
    cancel removes an invitation not used by then (else it is refused);
    states: cancelled, used, expired, pending."""
    c = cancels.groupBy("invitation_id").agg(F.min("cancel_at").alias("cancel_at"))
    j = invitations.join(c, F.col("id") == F.col("invitation_id"), "left")
    used_before = F.col("used_at").isNotNull() & (F.col("used_at") <= F.col("cancel_at"))
    cancelled = F.col("cancel_at").isNotNull() & (F.col("cancel_at") <= lit_ts(as_of)) & ~used_before
    state = (F.when(cancelled, "cancelled").when(F.col("used_at").isNotNull() & (F.col("used_at") <= lit_ts(as_of)), "used")
             .when(F.col("expires_at") <= lit_ts(as_of), "expired").otherwise("pending"))
    return j.select("id", "email", "role", state.alias("state"),
                    (F.col("cancel_at").isNotNull() & used_before).alias("cancel_refused"))


# Sign-up role rule -------------------------------------------------------
def signups_from_invitations(invitations: DataFrame) -> DataFrame:
    """Sign-up attempts: for invitations with id mod 3 = 0 the invitee signs
    up three days later with the token (with another e-mail when id mod 9 =
    0); for id mod 3 = 1 someone signs up without a token."""
    k = F.col("id")
    return invitations.where(k % 3 != 2).select(
        k.alias("seq"),
        F.when(k % 9 == 0, F.concat(F.lit("other"), k.cast("string"), F.lit("@example.com")))
         .otherwise(F.col("email")).alias("email"),
        F.when(k % 3 == 0, k).alias("token_invitation_id"),
        (F.col("created_at") + F.expr("INTERVAL 3 DAYS")).alias("attempt_at"))


def signup_roles(users: DataFrame, invitations: DataFrame, signups: DataFrame) -> DataFrame:
    """Role for each sign-up or the reason it is refused, as if they came one
    by one in the order of (attempt_at, seq): e-mail in use (by a user or an
    earlier accepted sign-up); with a token: invitation unused and unexpired at
    that time and for the same e-mail -> its role; without a token: admin if
    there is none yet.

    A token's sign-ups are accepted for its invitation's e-mail only, so per
    e-mail the first one that is valid by itself wins; of the sign-ups without
    a token at most the first one whose e-mail is free then, before any admin
    signed up by a token, becomes the admin."""
    signups = signups.withColumn("email", E.clean_email(F.col("email")))
    users = users.withColumn("email", E.clean_email(F.col("email")))
    inv = invitations.select(F.col("id").alias("__iid"), E.clean_email(F.col("email")).alias("__iemail"),
                             F.col("role").alias("__irole"), F.col("used_at").alias("__used"),
                             F.col("expires_at").alias("__exp"))
    j = (signups.withColumn("__at", F.struct("attempt_at", "seq"))
         .join(users.groupBy("email").agg(F.lit(True).alias("__taken")), "email", "left")
         .join(inv, F.col("token_invitation_id") == F.col("__iid"), "left"))
    tok = F.col("token_invitation_id").isNotNull()
    unusable = (F.col("__iid").isNull() | (F.col("__used").isNotNull() & (F.col("__used") <= F.col("attempt_at")))
                | (F.col("__exp") <= F.col("attempt_at")))
    j = cut_lineage(j.withColumn("__by_token", tok & F.col("__taken").isNull() & ~unusable
                                 & (F.col("__iemail") == F.col("email"))).withColumn("__unusable", unusable))
    first = j.where("__by_token").groupBy("email").agg(
        F.min(F.struct("__at", "__irole", "token_invitation_id")).alias("__first"))
    # the admin grant: none if there is an admin, or one comes by token first
    there = users.where(F.col("role") == "admin").select(F.count(F.lit(1))).scalar()
    by_token = first.where(F.col("__first.__irole") == "admin").select(F.min("__first.__at")).scalar()
    grant = (j.where(~tok & F.col("__taken").isNull()).join(first, "email", "left")
             .where(F.col("__first").isNull() | (F.col("__at") < F.col("__first.__at")))
             .agg(F.min(F.struct("__at", "email")).alias("__g"))
             .where((there == 0) & F.col("__g").isNotNull() & (by_token.isNull() | (F.col("__g.__at") < by_token)))
             .select(F.col("__g.email").alias("email"), F.col("__g.__at").alias("__grant")))
    admin_at = F.least(by_token, grant.select("__grant").scalar())
    won = (first.join(grant, "email", "full")
           .select("email", F.least("__grant", F.col("__first.__at")).alias("__won"),
                   F.when(F.col("__grant").isNull() | (F.col("__first.__at") < F.col("__grant")),
                          F.col("__first.token_invitation_id")).alias("__token")))
    spent = won.where(F.col("__token").isNotNull()).select(F.col("__token").alias("token_invitation_id"),
                                                          F.col("__won").alias("__spent"))
    j = j.join(won.select("email", "__won"), "email", "left").join(spent, "token_invitation_id", "left")
    reason = (F.when(F.col("__taken") | (F.col("__won") < F.col("__at")), "email_exists")
              .when(tok & (F.col("__unusable") | (F.col("__spent") < F.col("__at"))), "invalid_or_expired")
              .when(tok & (F.col("__iemail") != F.col("email")), "email_mismatch")
              .when(~tok & ((there > 0) | (admin_at < F.col("__at"))), "admin_exists"))
    j = j.withColumn("reason", reason)
    role = F.when(F.col("reason").isNull(), F.when(tok, F.col("__irole")).otherwise(F.lit("admin")))
    return j.select("seq", "email", "token_invitation_id", role.alias("role"), "reason")


def invitations_after_signups(invitations: DataFrame, decisions: DataFrame) -> DataFrame:
    """An accepted sign-up with a token marks its invitation used at
    the sign-up time (other invitations unchanged)."""
    used = (decisions.where(F.col("reason").isNull() & F.col("token_invitation_id").isNotNull())
            .select(F.col("token_invitation_id").alias("__iid"), F.col("attempt_at").alias("__at")))
    j = invitations.join(used, F.col("id") == F.col("__iid"), "left")
    return j.select(*[F.col(c) for c in invitations.columns if c != "used_at"],
                    F.coalesce(F.col("__at"), F.col("used_at")).alias("used_at")).select(*invitations.columns)


# W16 for the admin jobs -------------------------------------------------------
def admin_change_log(clients_before: DataFrame, client_changes: DataFrame, client_decisions: DataFrame,
                     users_before: DataFrame, user_changes: DataFrame, user_decisions: DataFrame) -> DataFrame:
    """Activity rows of the accepted client and user changes, as the tracker
    logs them: create_client / update_client / delete_client (deactivation),
    update_user (deactivating a user is not logged). target_name is the
    row's name."""
    def ok(d):
        return d.where(F.col("accepted")).select("seq")
    cl_names = clients_before.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    cl = (client_changes.join(ok(client_decisions), "seq", "left_semi")
          .join(cl_names, F.col("target_id") == F.col("__id"), "left")
          .select(F.col("seq"), F.col("actor_id").alias("user_id"),
                  F.when(F.col("op") == "insert", "create_client").when(F.col("op") == "deactivate", "delete_client")
                   .otherwise("update_client").alias("action"),
                  F.lit("client").alias("target_type"), F.col("target_id"),
                  F.coalesce(F.col("name"), F.col("__name")).alias("target_name"),
                  F.col("changed_at").alias("created_at")))
    us_names = users_before.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    us = (user_changes.join(ok(user_decisions), "seq", "left_semi").where(F.col("op") != "deactivate")
          .join(us_names, F.col("target_id") == F.col("__id"), "left")
          .select(F.col("seq"), F.col("actor_id").alias("user_id"), F.lit("update_user").alias("action"),
                  F.lit("user").alias("target_type"), F.col("target_id"),
                  F.when(F.col("op") == "name", F.col("new_value")).otherwise(F.col("__name")).alias("target_name"),
                  F.col("changed_at").alias("created_at")))
    return cl.unionByName(us)
