"""Creating invitations, with both refusals, as if requests came one by one.

A request is refused if its (cleaned) e-mail belongs to a user, or has an
invitation that is neither used nor expired nor cancelled at that time. The
invitations of the table block by their intervals alone. Of the requests that
are left, an accepted one blocks its e-mail until it expires or is cancelled, so
the accepted ones are a chain per e-mail: the first request, then always the
first one at or after the end of the last accepted one (``plans.chains``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake import schemas
from ticketlake.functions import expressions as E
from ticketlake.plans.chains import BITS, chain
from ticketlake.plans.joins import cut_lineage
from ticketlake.plans.prefix import as_of

NEW_IDS = 30_000_000  # an invitation's id is this plus the seq of its request


def requests_from_events(events: DataFrame) -> DataFrame:
    """Invitation requests from view events with event_id mod 5 = 0: for the
    e-mail invitee<user_id> (for event_id mod 7 = 0 that of user <user_id mod
    100>, with capitals and blanks for mod 3 = 0, without a domain for mod 20 =
    15), role by event_id mod 4 (3: 'owner', which is none); the admin is user
    (event_id mod 5) * 20."""
    eid, uid = F.col("event_id"), F.col("user_id")
    who = F.when(eid % 7 == 0, F.concat(F.lit("user"), (uid % 100).cast("string"))).otherwise(
        F.concat(F.lit("invitee"), uid.cast("string")))
    email = (F.when(eid % 20 == 15, who).when(eid % 3 == 0, F.concat(F.lit("  "), F.initcap(who), F.lit("@Example.COM ")))
             .otherwise(F.concat(who, F.lit("@example.com"))))
    roles = F.array(*(F.lit(r) for r in [*schemas.ROLES, "owner"]))
    return events.where((F.col("event_type") == "view") & (eid % 5 == 0)).select(
        eid.cast("bigint").alias("seq"), email.alias("email"),
        F.element_at(roles, (F.floor(eid / 5) % 4 + 1).cast("int")).alias("role"),
        ((eid % 5) * 20).cast("bigint").alias("actor_id"), F.col("ts").cast("timestamp_ntz").alias("asked_at"))


def cancellations(requests: DataFrame) -> DataFrame:
    """Cancel requests: the new invitations of seq mod 11 = 0, a day later."""
    return requests.where(F.col("seq") % 11 == 0).select(
        (F.col("seq") + NEW_IDS).alias("invitation_id"), (F.col("asked_at") + F.expr("INTERVAL 1 DAY")).alias("cancel_at"))


def micros(column: str):
    return F.unix_micros(E.utc_instant(F.col(column)))


def first_cancel(created: DataFrame, column: str, cancels: DataFrame, shift: int) -> DataFrame:
    """(id, cancel_at): the first cancel of each row of ``created`` (id, time in
    ``column``) that comes after it; an earlier one finds no invitation."""
    c = cancels.select((F.col("invitation_id") - shift).alias("id"), "cancel_at")
    return (created.select("id", F.col(column).alias("__at")).join(c, "id").where(F.col("cancel_at") > F.col("__at"))
            .groupBy("id").agg(F.min("cancel_at").alias("cancel_at")))


def invite_users(users: DataFrame, invitations: DataFrame, requests: DataFrame, cancels: DataFrame) -> DataFrame:
    """Decisions: seq, email (cleaned), role, invitation_id and expires_at of the
    new invitation, accepted, reason (bad_email, bad_role, user_exists, pending_exists)."""
    life = F.expr(f"INTERVAL {schemas.INVITATION_DAYS} DAYS")
    there = users.select(E.clean_email(F.col("email")).alias("email")).distinct().withColumn("__user", F.lit(True))
    r = requests.withColumn("email", E.clean_email(F.col("email"))).join(there, "email", "left").withColumn(
        "reason", F.when(~F.coalesce(E.email_ok(F.col("email")), F.lit(False)), "bad_email")
        .when(~F.coalesce(F.col("role").isin(*schemas.ROLES), F.lit(False)), "bad_role")
        .when(F.col("__user"), "user_exists"))
    r = cut_lineage(r.select("seq", "email", "role", "actor_id", "asked_at", micros("asked_at").alias("at"), "reason"))

    # the table's invitations: the latest end among those created by then
    old = invitations.join(first_cancel(invitations, "created_at", cancels, 0), "id", "left").select(
        E.clean_email(F.col("email")).alias("email"), micros("created_at").alias("start"),
        F.least(micros("expires_at"), micros("used_at"), micros("cancel_at")).alias("end"))
    old = old.groupBy("email", "start").agg(F.struct(F.max("end").alias("end")).alias("v"))
    open_ = r.where("reason is null").groupBy("email", "at").agg(F.min("seq").alias("seq")) \
        .withColumn("upto", F.col("at") + 1)
    open_ = as_of(open_, old, "email", "upto", "v", "busy", bits=BITS, start="start")
    free = open_.where("busy is null or busy.end <= at")

    own_end = first_cancel(requests.select(F.col("seq").alias("id"), "asked_at"), "asked_at", cancels, NEW_IDS) \
        .select(F.col("id").alias("seq"), micros("cancel_at").alias("cancel"))
    until = F.col("at") + schemas.INVITATION_DAYS * 86_400_000_000
    points = cut_lineage(free.join(own_end, "seq", "left").select(
        "seq", F.col("email").alias("key"), "at",
        F.least("cancel", until).alias("until")))
    taken = points.join(chain(points.select("key", "at", "until")), ["key", "at"]).select("seq", F.lit(True).alias("__ok"))
    d = r.join(taken, "seq", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("__ok").isNull(), "pending_exists")))
    accepted = F.col("reason").isNull()
    return d.select("seq", "email", "role", F.when(accepted, F.col("seq") + NEW_IDS).alias("invitation_id"),
                    F.when(accepted, F.col("asked_at") + life).alias("expires_at"), accepted.alias("accepted"), "reason",
                    "actor_id", "asked_at")


def account_log(users: DataFrame, decisions: DataFrame, invitations: DataFrame, cancels: DataFrame,
                lifecycle: DataFrame, logins: DataFrame) -> DataFrame:
    """Activity rows of accounts: accepted invitations (invite_user), cancels that
    found an unused one (cancel_invitation, of old and of new ones, by the admin of
    the request or the inviter), and logins of active users."""
    invited = decisions.where("accepted").select(
        F.col("actor_id").alias("user_id"), F.lit("invite_user").alias("action"), F.lit("invitation").alias("target_type"),
        F.col("invitation_id").alias("target_id"), F.col("email").alias("target_name"), F.col("asked_at").alias("created_at"))
    first = cancels.groupBy("invitation_id").agg(F.min("cancel_at").alias("cancel_at"))
    done = lifecycle.where("state = 'cancelled'").select("id").join(invitations.select("id", "created_by"), "id") \
        .select(F.col("created_by").alias("by"), F.col("id").alias("invitation_id"))
    done = done.unionByName(decisions.where("accepted").select(F.col("actor_id").alias("by"), "invitation_id"))
    cancelled = first.join(done, "invitation_id").select(
        F.col("by").alias("user_id"), F.lit("cancel_invitation").alias("action"), F.lit("invitation").alias("target_type"),
        F.col("invitation_id").alias("target_id"), F.lit("").alias("target_name"), F.col("cancel_at").alias("created_at"))
    came = logins.join(users.where("active").select(F.col("id").alias("user_id"), "name"), "user_id").select(
        "user_id", F.lit("login").alias("action"), F.lit("user").alias("target_type"), F.col("user_id").alias("target_id"),
        F.col("name").alias("target_name"), "created_at")
    return invited.unionByName(cancelled).unionByName(came)
