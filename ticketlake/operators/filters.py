"""Predicates. Each returns a Column; lists of conditions are folded
with AND (F2) so the same predicate serves the count and the page. All are
plain comparisons on columns, so Catalyst pushes them below joins and into the
Parquet scan (PushedFilters) where the source supports it.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlake import schemas
from ticketlake.functions.expressions import clean_email, lit_ts


def _given(v) -> bool:
    """A filter value is used only if given and not blank (F1)."""
    return v is not None and not (isinstance(v, str) and v.strip() == "")


def conjunction(preds: list[Column]) -> Column:
    """AND of all conditions; TRUE when there are none."""
    return functools.reduce(operator.and_, preds, F.lit(True))


def like_pattern(q: Column) -> Column:
    """``%q%`` with the tracker's meaning: ``%`` and ``_`` are wildcards, a
    backslash makes the next character a plain one (Spark takes it before a
    wildcard or another backslash only, so it goes elsewhere)."""
    return F.regexp_replace(F.concat(F.lit("%"), q, F.lit("%")), r"(?s)(\\[%_\\])|\\(.)", "$1$2")


def contains_any(columns: list[str], q: str) -> Column:
    """case-insensitive contains on any column. The text is not escaped,
    so ``%`` and ``_`` act as wildcards, as in the tracker."""
    pat = like_pattern(F.lit(q))
    return functools.reduce(operator.or_, [F.ilike(F.col(c), pat) for c in columns])


def scope(role: str | None, user_id) -> list[Column]:
    """agents see only their own notes."""
    return [F.col("agent_id") == F.lit(int(user_id))] if role == "agent" else []


@dataclass(frozen=True)
class NoteQuery:
    """The note list's filters (all optional) and the caller's identity."""

    status: str | None = None
    priority: str | None = None
    category_id: int | None = None
    client_id: int | None = None
    agent_id: int | None = None
    q: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    role: str | None = None
    user_id: int | None = None

    def predicates(self) -> list[Column]:
        preds = scope(self.role, self.user_id)
        for col in ("status", "priority"):
            v = getattr(self, col)
            if _given(v):
                preds.append(F.col(col) == F.lit(v))
        for col in ("category_id", "client_id", "agent_id"):
            v = getattr(self, col)
            if _given(v):
                preds.append(F.col(col) == F.lit(int(v)))
        if _given(self.q):
            preds.append(contains_any(["title", "description"], self.q))
        # both ends inclusive on the timestamp; a bare date 'to' excludes the rest of that day
        if _given(self.date_from):
            preds.append(F.col("created_at") >= lit_ts(self.date_from))
        if _given(self.date_to):
            preds.append(F.col("created_at") <= lit_ts(self.date_to))
        return preds

    def predicate(self) -> Column:
        return conjunction(self.predicates())


def client_search(q: str | None) -> Column:
    """F9 + F4: active clients, optionally matching name, phone or email."""
    preds = [F.col("active") == F.lit(True)]
    if _given(q):
        preds.append(contains_any(["name", "phone", "email"], q))
    return conjunction(preds)


def title_query_ok(q: str | None) -> bool:
    """a duplicate search needs at least 3 characters."""
    return q is not None and len(q) >= schemas.SEARCH_MIN_CHARS


def roots_only() -> Column:
    """F10."""
    return F.col("parent_id").isNull()


def agents_only() -> Column:
    """F11."""
    return F.col("role") == F.lit("agent")


def pending_invitation(as_of) -> Column:
    """not used and not expired at ``as_of``."""
    return F.col("used_at").isNull() & (F.col("expires_at") > lit_ts(as_of))


def login_user(email: str) -> Column:
    """the active user of an e-mail, however it is typed."""
    return (clean_email(F.col("email")) == clean_email(F.lit(email))) & F.col("active")


def unused_invitation(invitation_id: int) -> Column:
    """an invitation by id that hasn't been used."""
    return key_equals("id", int(invitation_id)) & F.col("used_at").isNull()


def key_equals(column: str, value) -> Column:
    """point lookup."""
    return F.col(column) == F.lit(value)
