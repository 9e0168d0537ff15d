"""Q1-Q8: the tracker's constraints as data-quality jobs.

Each check returns violating rows with a rule name; ``summary`` counts them
per rule. References are ``left_anti`` joins of the distinct keys (so a hot key
costs one row per task), uniqueness is a grouped count, and all domain and text
rules of a table are tested in one scan of it. Nothing is collected.
``broken`` derives tables that break every rule.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake import schemas
from ticketlake.functions.expressions import clean_email, email_ok
from ticketlake.operators.filters import pending_invitation

VIOLATION_COLS = ["rule", "table_name", "row_id", "value"]


def _v(df: DataFrame, rule: str, table: str, row_id: str, value) -> DataFrame:
    val = F.col(value).cast("string") if isinstance(value, str) else value.cast("string")
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                     F.col(row_id).cast("bigint").alias("row_id"), val.alias("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


# Q1 ---------------------------------------------------------------------------
def orphans(users, clients, categories, notes, activity, invitations) -> DataFrame:
    """Foreign keys that point at no row."""
    def dangling(df, fk, target, table, rule):
        keys = target.select(F.col("id").alias("__ref"))
        lost = (df.where(F.col(fk).isNotNull()).select(F.col(fk).alias("__fk")).distinct()
                .join(keys, F.col("__fk") == F.col("__ref"), "left_anti"))
        return _v(df.join(lost, F.col(fk) == F.col("__fk"), "left_semi"), rule, table, "id", fk)
    return _union([
        dangling(notes, "client_id", clients, "notes", "orphan_client"),
        dangling(notes, "agent_id", users, "notes", "orphan_agent"),
        dangling(notes, "category_id", categories, "notes", "orphan_category"),
        dangling(categories, "parent_id", categories, "categories", "orphan_parent"),
        dangling(activity, "user_id", users, "activity_logs", "orphan_log_user"),
        dangling(invitations, "created_by", users, "invitations", "orphan_inviter"),
    ])


# Q2 ---------------------------------------------------------------------------
def duplicates(users, clients, categories, notes, activity, invitations) -> DataFrame:
    """Values that must be unique but occur more than once (one row per value)."""
    def dup(df, col, table, rule):
        g = (df.where(F.col(col).isNotNull()).groupBy(col)
             .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where(F.col("n") > 1))
        return g.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                        F.col("first_id").cast("bigint").alias("row_id"),
                        F.concat(F.col(col).cast("string"), F.lit(" x"), F.col("n").cast("string")).alias("value"))
    parts = [dup(users, "email", "users", "unique_email"), dup(clients, "phone", "clients", "unique_phone")]
    for name, df in (("users", users), ("clients", clients), ("categories", categories), ("notes", notes),
                     ("activity_logs", activity), ("invitations", invitations)):
        parts.append(dup(df.withColumn("__key", F.col("id")), "__key", name, "unique_key"))
    return _union(parts)


def incoming_conflicts(incoming: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Q2 for writes: incoming rows whose unique value already exists."""
    return incoming.join(current.select(column).distinct(), column, "left_semi")


def row_rules(df: DataFrame, table: str, rules: list[tuple]) -> DataFrame:
    """Violations of ``(rule, column, condition)`` rules in one scan."""
    broken = F.array_compact(F.array(*(
        F.when(cond, F.struct(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("value")))
        for rule, c, cond in rules)))
    return (df.select(F.col("id").cast("bigint").alias("row_id"), F.explode(broken).alias("b"))
            .select("b.rule", F.lit(table).alias("table_name"), "row_id", "b.value"))


# Q3 ---------------------------------------------------------------------------
def domain_violations(users, notes, invitations) -> DataFrame:
    def bad(c, allowed):
        return f"domain_{c}", c, F.col(c).isNull() | ~F.col(c).isin(*allowed)
    return _union([
        row_rules(users, "users", [bad("role", schemas.ROLES)]),
        row_rules(invitations, "invitations", [bad("role", schemas.ROLES)]),
        row_rules(notes, "notes", [bad("priority", schemas.PRIORITIES), bad("status", schemas.STATUSES)]),
    ])


# Q4, Q5, Q6 -------------------------------------------------------------------
NOT_BLANK = {"users": ["name", "email"], "clients": ["name", "phone"], "categories": ["name"], "notes": ["title"],
             "activity_logs": ["action"], "invitations": ["email"]}
NOT_NULL = {"notes": ["client_id", "agent_id"]}


def text_violations(users, clients, categories, notes, activity, invitations) -> DataFrame:
    parts = []
    for table, df in (("users", users), ("clients", clients), ("categories", categories), ("notes", notes),
                      ("activity_logs", activity), ("invitations", invitations)):
        rules = [(f"blank_{c}", c, F.col(c).isNull() | (F.trim(F.col(c)) == "")) for c in NOT_BLANK[table]]
        rules += [(f"missing_{c}", c, F.col(c).isNull()) for c in NOT_NULL.get(table, [])]
        for key, limit in schemas.MAX_LENGTH.items():
            t, c = key.split(".")
            if t == table and c in df.columns:
                rules.append((f"too_long_{c}", c, F.length(F.col(c)) > limit))
        if table == "notes":
            rules.append(("counter_min", "counter", F.col("counter").isNull() | (F.col("counter") < 1)))
        if "email" in df.columns:
            e = F.col("email")
            rules.append(("email_form", "email", e.isNotNull() & ~email_ok(e)))
            # Stored e-mails are normalised (trimmed, lower case) before store and compare
            rules.append(("email_not_normalized", "email", e.isNotNull() & (e != clean_email(e))))
        parts.append(row_rules(df, table, rules))
    return _union(parts)


def broken(users, clients, categories, notes, activity, invitations) -> tuple[DataFrame, ...]:
    """The six tables with values, by id modulo small primes, that break the
    rules: for checking that every rule finds its rows."""
    def put(df, **new):
        return df.withColumns({c: F.coalesce(*(F.when(F.col("id") % m == r, F.lit(v)) for m, r, v in cases), F.col(c))
                               for c, cases in new.items()})
    gone = 99_999_999
    lost = lambda df, c, m: df.withColumn(c, F.when(F.col("id") % m != 0, F.col(c)))
    return (put(users, name=[(7, 3, "  ")], role=[(5, 1, "boss")],
                email=[(11, 2, " User@EXAMPLE.com"), (13, 4, "nobody"), (17, 5, "user1@example.com")]),
            lost(put(clients, phone=[(19, 1, "+1-555-0000002")], company=[(29, 1, "x" * 151)]), "name", 23),
            put(categories, name=[(6, 1, "")], parent_id=[(7, 2, gone)]),
            lost(lost(put(notes, status=[(97, 0, "Closed")], counter=[(83, 0, 0)], title=[(79, 0, "t" * 256)],
                          client_id=[(73, 0, gone)], category_id=[(59, 0, gone)]), "agent_id", 71), "priority", 89),
            put(activity, action=[(67, 0, "a" * 101), (53, 0, "")], user_id=[(61, 0, gone)]),
            put(invitations, email=[(3, 0, "x y@z")], role=[(4, 1, "guest")], created_by=[(6, 2, gone)]))


def all_rules(users, clients, categories, notes, activity, invitations) -> DataFrame:
    """Violations of all rules about single tables and references."""
    t = (users, clients, categories, notes, activity, invitations)
    return _union([orphans(*t), duplicates(*t), domain_violations(users, notes, invitations), text_violations(*t)])


# Q7 ---------------------------------------------------------------------------
def pending_conflicts(users, invitations, as_of) -> DataFrame:
    """More than one pending invitation per e-mail; a pending invitation for
    an e-mail that already has a user."""
    pend = invitations.where(pending_invitation(as_of))
    multi = (pend.groupBy("email").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
             .where(F.col("n") > 1)
             .select(F.lit("pending_twice").alias("rule"), F.lit("invitations").alias("table_name"),
                     F.col("first_id").cast("bigint").alias("row_id"),
                     F.concat(F.col("email"), F.lit(" x"), F.col("n").cast("string")).alias("value")))
    existing = _v(pend.join(users.select("email"), "email", "left_semi"), "invited_existing_user",
                  "invitations", "id", "email")
    return multi.unionByName(existing)


# Q8 ---------------------------------------------------------------------------
def count_drift(clients_with_count: DataFrame, notes: DataFrame) -> DataFrame:
    """Clients whose stored ``notes_count`` differs from a recount."""
    actual = notes.groupBy("client_id").agg(F.count(F.lit(1)).cast("bigint").alias("actual"))
    j = clients_with_count.join(actual, F.col("id") == F.col("client_id"), "left")
    a = F.coalesce("actual", F.lit(0)).cast("bigint")
    return (j.where(F.col("notes_count").cast("bigint") != a)
            .select(F.col("id").alias("client_id"), F.col("notes_count").cast("bigint").alias("stored"),
                    a.alias("actual")))


def summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule", "table_name").agg(F.count(F.lit(1)).cast("bigint").alias("violations"))
