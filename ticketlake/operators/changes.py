"""The note write rules as one batch job.

``apply_note_changes(notes, changes, clients)`` takes the current snapshot
and a change set ``(seq, note_id, op, field, new_value, client_id,
changed_at, title, agent_id)`` and returns the new snapshot, the applied
changes, the activity rows to append and the maintained client counts.

Rules kept from the tracker:

* ``seq`` is the order of application; a change to a note that does not
  exist at that point (never inserted, or already deleted) is ignored;
* insert: defaults Medium / Open / counter 1, no ``resolved_at`` even when
  created resolved; the client must exist; an id that exists is refused;
* patch: one of six fields; a given NULL wins over the old value (a missing
  field keeps it); status/priority must be in their domain; title and
  client may not be NULL; status Resolved sets ``resolved_at`` to the
  change time (again, on every such patch), any other status clears it;
* increment: +1 per event, several add up;
* every applied patch / increment touches ``updated_at`` (trigger W11);
* the client's ``notes_count`` moves +1 per insert and -1 per delete with a
  floor at 0 (W12), not on client changes of a note (as the trigger).

Plan: everything is grouped by ``note_id`` with partial aggregation (max of
(seq, value) structs, counts), then joined to the snapshot on ``id`` -- one
shuffle per side; AQE splits a hot note's partition. Running values for the
activity log (new counter, title at that time) and the floored client count
use the bucketed prefix helper, never a per-key window over a whole group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake import schemas
from ticketlake.functions.expressions import blank_to_null, not_blank
from ticketlake.plans.joins import cut_lineage
from ticketlake.plans.prefix import running, running_all

NOTE_COLS = [f.name for f in schemas.NOTES.fields]
ACTIONS = {"insert": "create_note", "patch": "update_note", "increment": "increment_counter",
           "delete": "delete_note"}


@dataclass
class NoteChangeResult:
    notes: DataFrame          # new snapshot
    inserted: DataFrame       # W1 rows created
    applied: DataFrame        # every applied change, with the note's start
    folded: DataFrame         # one row per touched note: aggregated effect
    activity: DataFrame       # W16 rows to append to activity_logs
    client_counts: DataFrame  # W12 maintained notes_count per client
    deleted: DataFrame        # W4 notes removed: id, client_id, __del_seq, __deleted_at


def _valid_patch() -> Column:
    f, v = F.col("field"), F.col("new_value")
    return (f.isin(*schemas.NOTE_PATCH_FIELDS)
            & ~(f.isin("status") & (v.isNull() | ~v.isin(*schemas.STATUSES)))
            & ~(f.isin("priority") & (v.isNull() | ~v.isin(*schemas.PRIORITIES)))
            & ~(f.isin("title", "client_id") & v.isNull())
            & ~(f.isin("client_id", "category_id") & v.isNotNull() & v.try_cast("bigint").isNull()))


GIVEN = {"actor_id": "bigint", "priority": "string", "status": "string", "category_id": "bigint", "description": "string"}


def with_given(changes: DataFrame) -> DataFrame:
    """The change set with the optional columns of ``GIVEN`` (NULL: not given)."""
    return changes.withColumns({c: F.lit(None).cast(t) for c, t in GIVEN.items() if c not in changes.columns})


def inserted(notes: DataFrame, changes: DataFrame, clients: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """First valid insert per new id (its client and its category, if given,
    exist, its title isn't blank, priority and status are known ones), with
    defaults for what isn't given; the title is stored trimmed."""
    valid = (changes.where((F.col("op") == "insert") & not_blank(F.col("title"))
                           & (F.col("priority").isNull() | F.col("priority").isin(*schemas.PRIORITIES))
                           & (F.col("status").isNull() | F.col("status").isin(*schemas.STATUSES)))
             .join(clients.select(F.col("id").alias("__cid")), F.col("client_id") == F.col("__cid"), "left_semi"))
    if categories is not None:
        known = categories.select(F.col("id").alias("__kid"), F.lit(True).alias("__there"))
        valid = (valid.join(known, F.col("category_id") == F.col("__kid"), "left")
                 .where(F.col("category_id").isNull() | F.col("__there")))
    first = (valid.groupBy("note_id")
             .agg(F.min(F.struct("seq", "client_id", "title", "agent_id", "changed_at", *GIVEN)).alias("i"))
             .select("note_id", "i.*"))
    ok = first.join(notes.select(F.col("id").alias("__id")), F.col("note_id") == F.col("__id"), "left_anti")
    return ok.select(
        F.col("note_id").alias("id"), "client_id", "agent_id",
        "category_id", F.trim("title").alias("title"), blank_to_null(F.col("description")).alias("description"),
        F.coalesce("priority", F.lit(schemas.DEFAULT_PRIORITY)).alias("priority"),
        F.coalesce("status", F.lit(schemas.DEFAULT_STATUS)).alias("status"),
        F.lit(schemas.DEFAULT_COUNTER).cast("int").alias("counter"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.col("changed_at").alias("created_at"), F.col("changed_at").alias("updated_at"),
        F.col("seq").alias("__start"), F.col("actor_id").alias("__actor"))


def _targets_exist(patches: DataFrame, clients: DataFrame, categories: DataFrame | None) -> DataFrame:
    """A client or category that a patch moves a note to must exist."""
    for field, target in (("client_id", clients), ("category_id", categories)):
        if target is None:
            continue
        known = target.select(F.col("id").alias("__tid"), F.lit(True).alias("__there"))
        moves = (F.col("op") == "patch") & (F.col("field") == field) & F.col("new_value").isNotNull()
        key = F.when(moves, F.col("new_value").try_cast("bigint"))
        patches = (patches.join(known, key == F.col("__tid"), "left")
                   .where(~moves | F.col("__there")).drop("__tid", "__there"))
    return patches


def apply_note_changes(notes: DataFrame, changes: DataFrame, clients: DataFrame,
                       categories: DataFrame | None = None) -> NoteChangeResult:
    changes = with_given(changes)
    ins = cut_lineage(inserted(notes, changes, clients, categories))
    live = (notes.select("id", F.lit(-1).cast("bigint").alias("__start"))
            .unionByName(ins.select("id", "__start")))
    other = (changes.where(F.col("op").isin("patch", "increment", "delete"))
             .where((F.col("op") != "patch") | F.coalesce(_valid_patch(), F.lit(False))))
    other = (_targets_exist(other, clients, categories)
             .join(live, F.col("note_id") == F.col("id")).drop("id")
             .where(F.col("seq") > F.col("__start")))
    dels = (other.where(F.col("op") == "delete").groupBy("note_id")
            .agg(F.min("seq").alias("__del")))
    # applied changes are read by the fold, the log and the deletes: computed once
    applied = cut_lineage(other.join(dels, "note_id", "left")
                          .where(F.col("__del").isNull() | (F.col("seq") <= F.col("__del"))).drop("__del"))

    # one row per touched note
    is_patch = F.col("op") == "patch"
    aggs = [F.count_if(F.col("op") == "increment").cast("int").alias("n_inc"),
            F.max(F.when(F.col("op") != "delete", F.struct("seq", "changed_at"))).alias("last_touch"),
            (F.count_if(F.col("op") == "delete") > 0).alias("deleted")]
    for f in schemas.NOTE_PATCH_FIELDS:
        aggs.append(F.max(F.when(is_patch & (F.col("field") == f),
                                 F.struct("seq", "new_value", "changed_at"))).alias(f"p_{f}"))
    folded = applied.groupBy("note_id").agg(*aggs)

    base = notes.select(*NOTE_COLS).unionByName(ins.select(*NOTE_COLS))
    j = base.join(folded, F.col("id") == F.col("note_id"), "left")

    def patched(f: str, cast: str | None = None) -> Column:
        v = F.col(f"p_{f}.new_value")
        if cast:
            v = v.try_cast(cast)
        return F.when(F.col(f"p_{f}").isNotNull(), v).otherwise(F.col(f))

    st = F.col("p_status")
    merged = j.select(
        "id", patched("client_id", "bigint").alias("client_id"), "agent_id",
        patched("category_id", "bigint").alias("category_id"), patched("title").alias("title"),
        patched("description").alias("description"), patched("priority").alias("priority"),
        patched("status").alias("status"),
        (F.col("counter") + F.coalesce("n_inc", F.lit(0))).cast("int").alias("counter"),
        F.when(st.isNull(), F.col("resolved_at"))
         .when(F.col("p_status.new_value") == "Resolved", F.col("p_status.changed_at"))
         .otherwise(F.lit(None).cast("timestamp_ntz")).alias("resolved_at"),
        "created_at",
        F.coalesce(F.col("last_touch.changed_at"), F.col("updated_at")).alias("updated_at"),
        F.coalesce("deleted", F.lit(False)).alias("__deleted"))
    new_notes = merged.where(~F.col("__deleted")).drop("__deleted")

    activity = change_log(notes, ins, applied)
    del_seq = applied.where(F.col("op") == "delete").select(F.col("note_id").alias("__nid"),
                                                              F.col("seq").alias("__del_seq"), F.col("changed_at").alias("__deleted_at"))
    deleted = (merged.where(F.col("__deleted")).join(del_seq, F.col("id") == F.col("__nid"))
               .select("id", "client_id", "__del_seq", "__deleted_at"))
    counts = client_counts_after(notes, clients, ins, deleted)
    return NoteChangeResult(new_notes, ins.drop("__start", "__actor"), applied, folded, activity, counts, deleted)


def write_version(result: NoteChangeResult, out_dir: str) -> dict[str, str]:
    """Write the job's outputs as a new version folder (never the input's);
    returns the paths. The outputs are independent jobs, submitted together."""
    import os
    from concurrent.futures import ThreadPoolExecutor
    names = ("notes", "inserted", "applied", "activity", "client_counts", "deleted")
    paths = {name: os.path.join(out_dir, name) for name in names}
    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        futures = [pool.submit(lambda n: getattr(result, n).write.mode("errorifexists").parquet(paths[n]), name)
                   for name in names]
        for f in futures:
            f.result()
    return paths


def read_version(spark, paths: dict[str, str]) -> NoteChangeResult:
    r = {k: spark.read.parquet(v) for k, v in paths.items()}
    return NoteChangeResult(r["notes"], r["inserted"], r["applied"], None, r["activity"],
                            r["client_counts"], r["deleted"])


# W16 --------------------------------------------------------------------------
def change_log(notes: DataFrame, ins: DataFrame, applied: DataFrame) -> DataFrame:
    """One activity row per applied change: action, target, title at that
    point, meta {"changes":[field]} for patches, {"new_counter":n} for
    increments; user_id is the change's actor."""
    touched = applied.select("note_id").distinct()
    start = (notes.select(F.col("id").alias("note_id"), "title", "counter")
             .unionByName(ins.select(F.col("id").alias("note_id"), "title", "counter"))
             .join(touched, "note_id", "left_semi"))
    rows = (applied.select("seq", "note_id", "op", "field", "new_value", "changed_at", "actor_id")
            .unionByName(start.select(F.lit(-1).cast("bigint").alias("seq"), "note_id",
                                      F.lit("start").alias("op"), F.lit(None).cast("string").alias("field"),
                                      F.col("title").alias("new_value"),
                                      F.lit(None).cast("timestamp_ntz").alias("changed_at"),
                                      F.lit(None).cast("bigint").alias("actor_id"))))
    rows = rows.join(start.select("note_id", F.col("counter").alias("__c0")), "note_id", "left")
    sets_title = (F.col("op") == "start") | ((F.col("op") == "patch") & (F.col("field") == "title"))
    rows = rows.withColumn("__t", F.when(sets_title, F.struct("seq", "new_value")))
    rows = rows.withColumn("__inc", (F.col("op") == "increment").cast("bigint"))
    rows = running_all(cut_lineage(rows), "note_id", "seq", {"__title": ("__t", "max"), "__ninc": ("__inc", "sum")})
    meta = (F.when(F.col("op") == "patch", F.to_json(F.struct(F.array(F.col("field")).alias("changes"))))
            .when(F.col("op") == "increment",
                  F.to_json(F.struct((F.col("__c0") + F.col("__ninc")).cast("bigint").alias("new_counter")))))
    action = F.element_at(F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))]), F.col("op"))
    upd = rows.where(F.col("op") != "start").select(
        F.col("seq").alias("id"), F.col("actor_id").alias("user_id"), action.alias("action"),
        F.lit("note").alias("target_type"), F.col("note_id").alias("target_id"),
        F.col("__title.new_value").alias("target_name"), meta.alias("meta"), F.col("changed_at").alias("created_at"))
    new = ins.select(F.col("__start").alias("id"), F.col("__actor").alias("user_id"),
                     F.lit("create_note").alias("action"), F.lit("note").alias("target_type"),
                     F.col("id").alias("target_id"), F.col("title").alias("target_name"),
                     F.lit(None).cast("string").alias("meta"), F.col("created_at"))
    return upd.unionByName(new)


# W12 --------------------------------------------------------------------------
def client_counts_after(notes: DataFrame, clients: DataFrame, ins: DataFrame, deleted: DataFrame) -> DataFrame:
    """notes_count and updated_at per client after the batch: the stored count (a
    recount of the snapshot where the table has none) moved +1 per insert and
    -1 per delete in seq order with a floor at 0; a client whose notes came or
    went is touched. With prefix sums S_k of the deltas and start x0, the
    floored result is S_n - min(-x0, min_k S_k). A count that has drifted stays
    so until it is repaired (``repaired_counts``)."""
    if "notes_count" in clients.columns:
        start = clients.select(F.col("id").alias("client_id"), F.coalesce("notes_count", F.lit(0)).cast("bigint").alias("x0"))
    else:
        start = notes.groupBy("client_id").agg(F.count(F.lit(1)).cast("bigint").alias("x0"))
    deltas = deltas_of(ins, deleted)
    counts = floored_counts(clients, start, deltas)
    if "updated_at" not in clients.columns:
        return counts
    last = deltas.groupBy("client_id").agg(F.max(F.struct("seq", "at")).alias("__last"))
    return (counts.join(last, "client_id", "left")
            .join(clients.select(F.col("id").alias("client_id"), F.col("updated_at").alias("__was")), "client_id")
            .select("client_id", "notes_count", F.coalesce("__last.at", "__was").alias("updated_at")))


def repaired_counts(clients: DataFrame, notes: DataFrame) -> DataFrame:
    """Clients with the stored count set to a recount where it has drifted, and
    whether it had. Counts are reduced to one row per client before the join."""
    now = notes.groupBy(F.col("client_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    n = F.coalesce("__n", F.lit(0)).cast("int")
    return (clients.join(now, "id", "left").withColumn("repaired", ~F.col("notes_count").eqNullSafe(n))
            .select(*(n.alias(c) if c == "notes_count" else F.col(c) for c in clients.columns), "repaired"))


def deltas_of(ins: DataFrame, deleted: DataFrame) -> DataFrame:
    """(client_id, seq, delta) for applied inserts (+1) and deletes (-1)."""
    plus = ins.select("client_id", F.col("__start").alias("seq"), F.lit(1).cast("bigint").alias("delta"),
                      F.col("created_at").alias("at"))
    minus = deleted.select("client_id", F.col("__del_seq").alias("seq"), F.lit(-1).cast("bigint").alias("delta"),
                           F.col("__deleted_at").alias("at"))
    return plus.unionByName(minus)


def floored_counts(clients: DataFrame, start: DataFrame, deltas: DataFrame) -> DataFrame:
    r = running(deltas, "client_id", "seq", "delta", "__s", how="sum")
    st = r.groupBy("client_id").agg(F.sum("delta").alias("sn"), F.min("__s").alias("smin"))
    j = (clients.select(F.col("id").alias("client_id"))
         .join(start, "client_id", "left").join(st, "client_id", "left"))
    x0 = F.coalesce("x0", F.lit(0)).cast("bigint")
    new = F.when(F.col("sn").isNull(), x0).otherwise(F.col("sn") - F.least(-x0, F.col("smin")))
    return j.select("client_id", new.cast("bigint").alias("notes_count"))


# W15 --------------------------------------------------------------------------
FOLD_MIN_CHARS = 4  # the form searches for duplicates from 4 typed characters


def fold_duplicates(notes: DataFrame, clients: DataFrame, categories: DataFrame, changes: DataFrame) -> DataFrame:
    """New notes, as if they were offered one by one in the order of seq. One whose
    title (of ``FOLD_MIN_CHARS`` or more) is contained in an existing note's title
    becomes an increment of the best such note (highest counter, then lowest id);
    else one whose title is contained in that of an earlier offer that was
    inserted becomes an increment of the first such offer's note; the rest stay
    inserts. Existing titles are matched as the search does it (the batch search,
    top 1), offers by their plain text without regard to case.

    Of the offers that match no existing note, the first whose title contains a
    given one is always inserted itself: whatever contained its title would
    contain the given one too, and come earlier. So one search of the offers
    among themselves, ranked by seq, gives what one after the other gives."""
    from ticketlake.operators.search import title_search_batch
    new = cut_lineage(changes.where(F.col("op") == "insert").select("seq", "note_id", "title"))
    long = F.length("title") >= FOLD_MIN_CHARS
    cands = new.where(long).select(F.col("seq").alias("cand_id"), F.col("title").alias("q"))
    best = cut_lineage(title_search_batch(notes, clients, categories, cands, top=1).select(
        F.col("cand_id").alias("seq"), F.col("id").alias("__match")))
    left = cut_lineage(new.where(long).join(best, "seq", "left_anti"))
    # the offers as notes that rank by their first seq
    first = left.groupBy("title").agg(F.min("seq").alias("id")).withColumn("counter", -F.col("id"))
    offered = first.select(*(F.col(c) if c in first.columns else F.lit(None).cast(notes.schema[c].dataType).alias(c)
                             for c in notes.columns))
    plain = F.regexp_replace("title", r"([\\%_])", r"\\$1")
    asked = left.select(F.col("seq").alias("cand_id"), plain.alias("q"))
    earlier = (title_search_batch(offered, clients, categories, asked, top=1)
               .where(F.col("id") < F.col("cand_id")).select(F.col("cand_id").alias("seq"), F.col("id").alias("__first")))
    owner = new.select(F.col("seq").alias("__first"), F.col("note_id").alias("__owner"))
    j = new.join(best, "seq", "left").join(earlier.join(owner, "__first").drop("__first"), "seq", "left")
    target = F.coalesce("__match", "__owner")
    return j.select("seq", "note_id", "title", F.when(target.isNull(), "insert").otherwise("increment").alias("decision"),
                    F.coalesce(target, F.col("note_id")).alias("target_id"))
