"""W2, W4 and the request rules: who may change a note, at the time of the change.

The users are a versioned dimension: every accepted user change opens a version
of its user's role or activity from its seq on. A note change is joined as of its
own seq with its actor's versions (``plans.prefix.as_of_all``), and with the note's
agent, which for a note of the same change set counts from its insert on. An
unknown or inactive actor is refused, an agent may delete nothing and may patch
only notes that he or she made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.operators.changes import inserted, with_given
from ticketlake.plans.joins import cut_lineage
from ticketlake.plans.prefix import as_of_all

BEFORE = -1


def user_versions(users: DataFrame, changes: DataFrame, decisions: DataFrame, field: str) -> DataFrame:
    """(actor_id, v: struct(start, value)) of ``field`` ('role' or 'active') as text."""
    sets = (F.col("op") == field) | ((F.col("op") == "deactivate") & F.lit(field == "active"))
    value = F.when(F.col("op") == "deactivate", "false").otherwise(F.col("new_value"))
    later = changes.where(sets).join(decisions.where("accepted").select("seq"), "seq", "left_semi")
    start = F.lit(BEFORE).cast("bigint").alias("start")
    return (users.select(F.col("id").alias("actor_id"), F.struct(start, F.col(field).cast("string").alias("value")).alias("v"))
            .unionByName(later.select(F.col("target_id").alias("actor_id"), F.struct(F.col("seq").alias("start"), value.alias("value"))
                                      .alias("v"))))


def note_permissions(notes: DataFrame, changes: DataFrame, clients: DataFrame, categories: DataFrame,
                     users: DataFrame, user_changes: DataFrame, user_decisions: DataFrame) -> DataFrame:
    """The note changes with ``reason`` (NULL: allowed): unknown_actor, inactive,
    forbidden (an agent's delete), not_owner (an agent's patch of a note that
    somebody else made, or of no note)."""
    c = with_given(changes)
    c = as_of_all(c, {f"__{field}": user_versions(users, user_changes, user_decisions, field) for field in ("role", "active")},
                  "actor_id", "seq", "v")
    known = users.select(F.col("id").alias("__uid"))
    c = c.join(known, F.col("actor_id") == F.col("__uid"), "left")
    active = F.col("__active.value").try_cast("boolean")
    c = cut_lineage(c.select(*with_given(changes).columns, F.col("__role.value").alias("__role"),
                             F.when(F.col("__uid").isNull(), "unknown_actor")
                             .when(~F.coalesce(active, F.lit(False)), "inactive").alias("reason")))
    agent = F.col("__role") == "agent"
    new = inserted(notes, c.where("reason is null"), clients, categories)
    maker = (notes.select(F.col("id").alias("note_id"), F.col("agent_id").alias("__maker"), F.lit(BEFORE).cast("bigint").alias("__from"))
             .unionByName(new.select(F.col("id").alias("note_id"), F.col("agent_id").alias("__maker"), F.col("__start").alias("__from"))))
    theirs = (F.col("__from") < F.col("seq")) & (F.col("__maker") == F.col("actor_id"))
    reason = F.coalesce("reason", F.when(agent & (F.col("op") == "delete"), "forbidden")
                        .when(agent & (F.col("op") == "patch") & ~F.coalesce(theirs, F.lit(False)), "not_owner"))
    return c.join(maker, "note_id", "left").select(*with_given(changes).columns, reason.alias("reason"))
