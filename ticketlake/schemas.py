"""Table schemas, value domains and defaults of the issue tracker.

Keys are bigint, times are timestamp_ntz read as UTC (the source Parquet is
zone-less). Credentials (password, invitation token) are never part of a
schema here.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the tracker's own) -----------------------------
ROLES = ["admin", "supervisor", "agent"]
PRIORITIES = ["Low", "Medium", "High"]
STATUSES = ["Open", "In Progress", "Resolved"]
DEFAULT_ROLE = "agent"
DEFAULT_PRIORITY = "Medium"
DEFAULT_STATUS = "Open"
DEFAULT_COUNTER = 1
INVITATION_DAYS = 7
PAGE_DEFAULT_LIMIT = 20
PAGE_MAX_LIMIT = 100
SEARCH_MIN_CHARS = 3
NOTE_PATCH_FIELDS = ["client_id", "category_id", "title", "description", "priority", "status"]
CLIENT_PATCH_FIELDS = ["name", "phone", "email", "company"]
USER_PATCH_FIELDS = ["name", "role", "active"]
MAX_LENGTH = {
    "users.name": 100, "users.email": 150, "users.role": 20,
    "clients.name": 150, "clients.phone": 30, "clients.email": 150, "clients.company": 150,
    "categories.name": 100, "notes.title": 255, "notes.priority": 10, "notes.status": 20,
    "activity_logs.action": 100, "activity_logs.target_type": 50, "activity_logs.target_name": 255,
    "invitations.email": 150, "invitations.role": 20,
}
# Action code -> label shown in the activity feed; unknown codes pass through.
ACTION_LABELS = {
    "create_note": "Created note",
    "update_note": "Updated note",
    "delete_note": "Deleted note",
    "increment_counter": "Incremented counter",
    "resolve_note": "Resolved note",
    "update_status": "Updated status",
    "create_client": "Added client",
    "update_client": "Updated client",
    "delete_client": "Deleted client",
    "create_user": "Created user",
    "update_user": "Updated user",
    "create_category": "Created category",
    "delete_category": "Deleted category",
    "login": "Logged in",
    "export": "Exported report",
}
# -----------------------------------------------------------------------------

L, S, B, I, TS = T.LongType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


USERS = _struct(("id", L, False), ("name", S, False), ("email", S, False), ("role", S, False),
                ("active", B, False), ("created_at", TS, False), ("updated_at", TS, True))
CLIENTS = _struct(("id", L, False), ("name", S, False), ("phone", S, False), ("email", S, True),
                  ("company", S, True), ("active", B, False), ("notes_count", I, True), ("created_at", TS, False),
                  ("updated_at", TS, True))
CATEGORIES = _struct(("id", L, False), ("name", S, False), ("parent_id", L, True))
NOTES = _struct(("id", L, False), ("client_id", L, False), ("agent_id", L, False),
                ("category_id", L, True), ("title", S, False), ("description", S, True),
                ("priority", S, False), ("status", S, False), ("counter", I, False),
                ("resolved_at", TS, True), ("created_at", TS, False), ("updated_at", TS, False))
ACTIVITY_LOGS = _struct(("id", L, False), ("user_id", L, True), ("action", S, False),
                        ("target_type", S, True), ("target_id", L, True), ("target_name", S, True), ("meta", S, True),
                        ("created_at", TS, False))
INVITATIONS = _struct(("id", L, False), ("email", S, False), ("role", S, False),
                      ("created_by", L, True), ("used_at", TS, True), ("created_at", TS, False),
                      ("expires_at", TS, False))
# One row per requested change: op in insert/patch/increment/delete; ``field``
# names the patched column (NULL for other ops); ``new_value`` may be NULL on
# purpose (field given, value NULL).
NOTE_CHANGES = _struct(("seq", L, False), ("note_id", L, False), ("op", S, False),
                       ("field", S, True), ("new_value", S, True), ("client_id", L, True),
                       ("changed_at", TS, False), ("title", S, True), ("agent_id", L, True),
                       ("actor_id", L, True), ("priority", S, True), ("status", S, True), ("category_id", L, True),
                       ("description", S, True))

SCHEMAS = {
    "users": USERS, "clients": CLIENTS, "categories": CATEGORIES, "notes": NOTES,
    "activity_logs": ACTIVITY_LOGS, "invitations": INVITATIONS, "note_changes": NOTE_CHANGES,
}
