"""The category tree.

Walks to the root are followed by pointer jumping (``jumps``), which is exact
at any depth: table k of the doubling holds every category's 2**k-th ancestor,
so a walk of d levels takes log2(d) joins. Where a walk ends -- a root, a
dangling parent id, or a loop -- is ``walk_ends``; whether it meets a category
is asked of the two depths' difference. All work on the category dimension
only; notes meet it after they are reduced to one row per category
(aggregate, then join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.operators.reports import notes_per_category
from ticketlake.plans.joins import cut_lineage


def jumps(categories: DataFrame) -> list[DataFrame]:
    """Tables (id, s, d) for k = 0, 1, ...: the walk of 2**k steps from id ends
    at s after d steps (a root, and a parent id missing from the table, stay
    where they are). 2**k of the last one exceeds the number of ids, so a walk
    that still moves there is in or under a loop. Each table joins the one
    before with itself, hence the cut per step."""
    cats = categories.select("id", "parent_id")
    missing = (cats.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id"))
               .join(cats.select("id"), "id", "left_anti").distinct())
    moves = F.col("parent_id").isNotNull().cast("bigint")
    st = cut_lineage(cats.select("id", F.coalesce("parent_id", "id").alias("s"), moves.alias("d"))
                     .unionByName(missing.select("id", F.col("id").alias("s"), F.lit(0).cast("bigint").alias("d"))))
    out = [st]
    for _ in range(max(1, int(st.count()).bit_length())):
        nxt = st.select(F.col("id").alias("__b"), F.col("s").alias("__bs"), F.col("d").alias("__bd"))
        st = cut_lineage(st.join(nxt, F.col("s") == F.col("__b"))
                         .select("id", F.col("__bs").alias("s"), (F.col("d") + F.col("__bd")).alias("d")))
        out.append(st)
    return out


def walk_ends(categories: DataFrame, tables: list[DataFrame] | None = None) -> DataFrame:
    """Per category: the last id of its upward walk, the number of steps, and
    how the walk ended: 'root', 'dangling' (parent id not in the table) or
    'loop'."""
    st = (tables or jumps(categories))[-1]
    cats = categories.select("id", "parent_id")
    c = cats.select(F.col("id").alias("__id"), F.col("parent_id").alias("__p"))
    j = (st.join(cats.select(F.col("id").alias("start")), F.col("id") == F.col("start"), "left_semi")
         .join(c, F.col("s") == F.col("__id"), "left"))
    end = (F.when(F.col("__id").isNull(), "dangling")
           .when(F.col("__p").isNull(), "root").otherwise("loop"))
    return j.select(F.col("id").alias("start"), F.col("s").alias("last"), F.col("d").alias("depth"), end.alias("end"))


# T1 ---------------------------------------------------------------------------
def categories_list(categories: DataFrame, notes: DataFrame) -> DataFrame:
    """Every category with its parent's name and the notes tagged on it,
    ordered parent NULLS FIRST, then name (id breaks ties)."""
    cnt = notes_per_category(notes)
    parent = categories.select(F.col("id").alias("__pid"), F.col("name").alias("parent_name"))
    return (categories.join(parent, F.col("parent_id") == F.col("__pid"), "left")
            .join(cnt, F.col("id") == F.col("category_id"), "left")
            .select("id", "name", "parent_id", "parent_name",
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("notes_count"))
            .orderBy(F.col("parent_id").asc_nulls_first(), F.col("name").asc(), F.col("id").asc()))


# T2, J15, A18 -----------------------------------------------------------------
def category_tree(categories: DataFrame, notes: DataFrame) -> DataFrame:
    """Two-level tree as rows: each root with each direct child (a root without
    children gives one row with NULL child), note counts and the number of
    children of the root."""
    cnt = notes_per_category(notes).select("category_id", "n")
    withn = (categories.join(cnt, F.col("id") == F.col("category_id"), "left")
             .select("id", "name", "parent_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("notes")))
    roots = withn.where(F.col("parent_id").isNull()).select(
        F.col("id").alias("root_id"), F.col("name").alias("root_name"), F.col("notes").alias("root_notes"))
    kids = withn.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("__parent"), F.col("id").alias("child_id"),
        F.col("name").alias("child_name"), F.col("notes").alias("child_notes"))
    nkids = kids.groupBy("__parent").agg(F.count(F.lit(1)).cast("bigint").alias("children_count"))
    return (roots.join(kids, F.col("root_id") == F.col("__parent"), "left").drop("__parent")
            .join(nkids, F.col("root_id") == F.col("__parent"), "left").drop("__parent")
            .withColumn("children_count", F.coalesce("children_count", F.lit(0)).cast("bigint")))


# T4 ---------------------------------------------------------------------------
def category_rollup(categories: DataFrame, notes: DataFrame) -> DataFrame:
    """Per root: notes tagged on the root or any descendant, and their summed
    counter (NULL without notes). Categories under a loop or a dangling
    parent belong to no root."""
    ends = walk_ends(categories).where(F.col("end") == "root")
    cnt = notes_per_category(notes)
    per_root = (cnt.join(ends, F.col("category_id") == F.col("start"))
                .groupBy(F.col("last").alias("root_id"))
                .agg(F.sum("n").cast("bigint").alias("n"), F.sum("occ").cast("bigint").alias("occ")))
    roots = categories.where(F.col("parent_id").isNull()).select("id", "name")
    return (roots.join(per_root, F.col("id") == F.col("root_id"), "left")
            .select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
                    F.col("occ").alias("total_occurrences")))


# T3 ---------------------------------------------------------------------------
def cycle_check(categories: DataFrame, proposals: DataFrame) -> DataFrame:
    """For proposals ``(category_id, new_parent_id)``: would the new parent make
    a loop? True when the ids are equal, when the walk up from the new parent
    meets the category, or when that walk is already in a loop. A NULL parent
    never loops; a missing parent ends the walk.

    A walk without a loop meets the category if the ancestor that lies as many
    levels up as the depths differ is the category; the proposals climb there
    by the bits of that difference."""
    tables = jumps(categories)
    ends = walk_ends(categories, tables)
    depth = tables[-1].select("id", "d")
    p = (proposals.select("category_id", "new_parent_id").distinct()
         .join(depth.select(F.col("id").alias("category_id"), F.col("d").alias("__dc")), "category_id", "left")
         .join(depth.select(F.col("id").alias("new_parent_id"), F.col("d").alias("__dp")), "new_parent_id", "left")
         .join(ends.where(F.col("end") == "loop").select(F.col("start").alias("new_parent_id"),
                                                         F.lit(True).alias("__loop")), "new_parent_id", "left")
         .withColumn("__up", F.col("__dp") - F.col("__dc")).withColumn("__at", F.col("new_parent_id")))
    for k, st in enumerate(tables):
        hop = st.select(F.col("id").alias("__at"), F.col("s").alias("__to"))
        bit = (F.col("__up") > 0) & (F.shiftright("__up", k) % 2 == 1)
        p = (p.join(hop, "__at", "left")
             .withColumn("__at", F.when(bit, F.col("__to")).otherwise(F.col("__at"))).drop("__to"))
    meets = (F.col("__up") >= 0) & (F.col("__at") == F.col("category_id"))
    circular = (F.when(F.col("new_parent_id").isNull(), F.lit(False))
                .when(F.col("category_id") == F.col("new_parent_id"), F.lit(True))
                .otherwise(F.coalesce(F.col("__loop"), F.lit(False)) | F.coalesce(meets, F.lit(False))))
    return p.select("category_id", "new_parent_id", circular.alias("circular"))


# T5 ---------------------------------------------------------------------------
def delete_guard(categories: DataFrame, notes: DataFrame, to_delete: DataFrame) -> DataFrame:
    """For ids to delete: refused (with the note count) when notes use them."""
    cnt = notes_per_category(notes).select("category_id", "n")
    d = to_delete.select(F.col("id")).distinct().join(categories.select("id"), "id", "left_semi")
    j = d.join(cnt, F.col("id") == F.col("category_id"), "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return j.select("id", n.alias("notes_using"), (n > 0).alias("refused"))
