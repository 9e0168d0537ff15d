"""Category inserts, patches and deletes, decided as if they came one by one.

A request's decision hangs on the tree as earlier accepted requests left it.
The tree is kept *as of*: every accepted request opens a version of its
category's parent edge, valid from its seq to the next one's, and a patch walks
upward from its new parent along the versions valid at its own seq. Walks of all
patches go together, one as-of join per level (``plans.prefix.as_of``: one
running maximum per category, so a category with many versions or many walkers
is never joined all with all). Categories that no request touches have one
parent for ever; stretches of them are jumped over (pointer doubling, before the
rounds), so a walk takes as many levels as it meets touched categories.

Rounds: each decides all requests from the last round's acceptances. A decision
depends on earlier ones only, so every round is right for one more undecided
request at least, in every tree at once, and a round that changes nothing has
the one-by-one result. Only patches whose category is somebody's parent in the
table or in a request can close a loop; no other one walks.

A job's overhead outweighs a round's work when there are few requests: up to
``FEW`` (requests x touched categories, counted) they are folded one after the
other by one ``aggregate`` expression over their array, with the touched
categories' parents in a map. Both ways give the same.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import expressions as E
from ticketlake.operators.reports import notes_per_category
from ticketlake.plans.joins import cut_lineage
from ticketlake.plans.prefix import as_of

FEW = 4_000_000  # up to so many (requests + walking patches) x touched categories are folded in one row
FIRST = -1  # the seq of everything that was there before the requests
REQUEST = "seq bigint, op string, target_id bigint, name string, parent_id bigint, actor_id bigint, changed_at timestamp_ntz"


def requests_from_nation(nation: DataFrame) -> DataFrame:
    """Requests per nation n (its region r, its category 100+n), in seq order:
    insert 300+n under 100+n (under the missing 250+n for n mod 5 = 3, with a
    blank name for n mod 5 = 4); move 100+n under root (r+1) mod 5; for even n
    put root r under 100+n (a loop unless that has moved away meanwhile); for odd n
    put 100+n under the new 300+n (a loop where that was inserted); delete
    200+n (missing), and for n = 0 the unused root 99; for n mod 6 = 2 delete
    300+n; rename 100+n when n mod 4 = 1 (no parent given: it is cleared). The
    admins are users (n mod 5) * 20, the times minutes of 2024-01-02."""
    n, r = F.col("n_nationkey").cast("bigint"), F.col("n_regionkey").cast("bigint")
    none = F.lit(None).cast("bigint")
    text = F.lit(None).cast("string")
    per = [
        ("insert", n + 300, F.when(n % 5 == 4, " ").otherwise(F.concat(F.lit("New "), n.cast("string"))),
         F.when(n % 5 == 3, n + 250).otherwise(n + 100), F.lit(True)),
        ("patch", n + 100, text, (r + 1) % 5, F.lit(True)),
        ("patch", r, text, n + 100, n % 2 == 0),
        ("patch", n + 100, text, n + 300, n % 2 == 1),
        ("delete", n + 200, text, none, F.lit(True)),
        ("delete", F.lit(99).cast("bigint"), text, none, n == 0),
        ("delete", n + 300, text, none, n % 6 == 2),
        ("patch", n + 100, F.concat(F.lit("Renamed "), n.cast("string")), none, n % 4 == 1),
    ]
    parts = [nation.where(keep).select(
        (n * 10 + k).alias("seq"), F.lit(op).alias("op"), target.alias("target_id"), name.alias("name"),
        parent.cast("bigint").alias("parent_id"), (n % 5 * 20).alias("actor_id"),
        (F.lit("2024-01-02 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(n * 10 + k).cast("int"))).alias("changed_at"))
        for k, (op, target, name, parent, keep) in enumerate(per, 1)]
    return functools.reduce(DataFrame.unionByName, parts)


def hops(categories: DataFrame, touched: DataFrame) -> DataFrame:
    """(id, to, round) of the categories that no request touches: the first
    touched category upward (NULL: the walk ends at a root or a missing id), or
    ``round`` for a loop of untouched ones, which the table shouldn't have."""
    fixed = categories.join(touched, "id", "left_anti")
    st = fixed.select("id", F.col("parent_id").alias("to"))
    inner = fixed.select(F.col("id").alias("to"))
    if st.join(inner, "to", "left_semi").isEmpty():
        return st.withColumn("round", F.lit(False))
    for _ in range(int(fixed.count()).bit_length()):
        nxt = st.select(F.col("id").alias("__b"), F.col("to").alias("__to"))
        st = cut_lineage(st.join(nxt, F.col("to") == F.col("__b"), "left")
                         .select("id", F.when(F.col("__b").isNotNull(), F.col("__to")).otherwise(F.col("to")).alias("to")))
    return st.join(inner.select(F.col("to").alias("__in")), F.col("to") == F.col("__in"), "left") \
        .select("id", "to", F.col("__in").isNotNull().alias("round"))


def over(df: DataFrame, column: str, hop: DataFrame) -> DataFrame:
    """Replace an untouched category in ``column`` by the first touched one above
    it; ``round`` tells that there is a loop instead."""
    h = hop.select(F.col("id").alias("__h"), F.col("to").alias("__to"), F.col("round").alias("__r"))
    keep = [c for c in df.columns if c not in (column, "round")]
    return df.join(h, F.col(column) == F.col("__h"), "left").select(
        *keep, F.when(F.col("__h").isNotNull(), F.col("__to")).otherwise(F.col(column)).alias(column),
        F.coalesce("__r", F.lit(False)).alias("round"))


def meeting(asks: DataFrame, versions: DataFrame) -> DataFrame:
    """seq of the ``asks`` (seq, goal, node, round) whose walk from ``node`` along
    the ``versions`` (node, v: struct(start, to, round)) meets ``goal``, or runs
    into a loop beside it. ``mark`` is the node of the last step that was a power
    of two: a walk that comes back to it goes round (Brent)."""
    walk = asks.select("seq", "goal", "node", "round", F.lit(None).cast("bigint").alias("mark"),
                       F.lit(0).cast("bigint").alias("steps"))
    found = None
    while True:
        arrived = F.coalesce(F.col("round") | (F.col("node") == F.col("goal")), F.lit(False))
        walk = as_of(walk, versions, "node", "seq", "v", "v")
        power = F.expr("(steps & (steps + 1)) = 0")
        walk = walk.select(
            "seq", "goal",
            F.when(arrived, F.col("goal")).otherwise(F.col("v.to")).alias("node"),
            (arrived | F.coalesce(F.col("v.round") | (F.col("v.to") == F.col("mark")), F.lit(False))).alias("round"),
            F.when(power, F.col("v.to")).otherwise(F.col("mark")).alias("mark"), (F.col("steps") + 1).alias("steps"))
        walk = cut_lineage(walk)
        hit = walk.where(F.col("round") | (F.col("node") == F.col("goal"))).select("seq")
        found = hit if found is None else found.unionByName(hit)
        walk = walk.where(~F.col("round") & F.col("node").isNotNull() & (F.col("node") != F.col("goal")))
        if walk.isEmpty():
            return found


def decided(categories: DataFrame, notes: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests with ``reason`` (NULL: accepted): blank_name, id_exists,
    parent_not_found, loop, not_found, in_use."""
    used = notes_per_category(notes).select(F.col("category_id").alias("target_id"), F.lit(True).alias("__used"))
    given, patch, insert, delete = F.col("parent_id").isNotNull(), *(F.col("op") == o for o in ("patch", "insert", "delete"))
    mothers = (categories.select(F.col("parent_id").alias("target_id")).unionByName(
        requests.select(F.col("parent_id").alias("target_id"))).where("target_id is not null").distinct()
        .withColumn("__mother", F.lit(True)))
    own = F.coalesce(F.col("target_id") == F.col("parent_id"), F.lit(False))
    blank = (insert | (patch & F.col("name").isNotNull())) & ~E.not_blank(F.coalesce("name", F.lit("")))
    c = cut_lineage(requests.join(used, "target_id", "left").join(mothers, "target_id", "left").select(
        *requests.columns,
        F.when(blank, "blank_name").when(patch & own, "loop").when(delete & F.col("__used"), "in_use").alias("first"),
        (patch & given & ~own & F.coalesce("__mother", F.lit(False))).alias("walks")))
    touched = c.select(F.col("target_id").alias("id")).distinct()
    work = c.agg((F.count("seq") + F.count_if("walks")) * F.count_distinct("target_id")).first()[0]
    hop = cut_lineage(hops(categories, touched))
    old = over(categories.join(touched, "id", "left_semi").select(
        F.col("id").alias("node"), F.lit(FIRST).cast("bigint").alias("start"), F.col("parent_id").alias("to")), "to", hop)
    edges = over(c.select("seq", F.col("target_id").alias("node"), F.when(~delete, F.col("parent_id")).alias("to")), "to", hop)
    if work <= FEW:
        return folded(categories, c, old, edges).drop("first", "walks")
    return in_rounds(categories, c, old, edges.withColumnRenamed("seq", "start")).drop("first", "walks")


def folded(categories: DataFrame, c: DataFrame, old: DataFrame, edges: DataFrame) -> DataFrame:
    """One request after the other in an ``aggregate`` over all of them."""
    ids = categories.select("id").distinct()
    known = ids.select(F.col("id").alias("target_id"), F.lit(True).alias("old_target"))
    still = ids.join(c.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti") \
        .select(F.col("id").alias("parent_id"), F.lit(True).alias("fixed_parent"))
    rows = (c.join(edges.select("seq", "to", "round"), "seq").join(known, "target_id", "left").join(still, "parent_id", "left")
            .agg(F.sort_array(F.collect_list(F.struct(
                "seq", "op", "target_id", "parent_id", "first", "walks", "to", "round",
                F.coalesce("old_target", F.lit(False)).alias("old_target"),
                F.coalesce("fixed_parent", F.lit(False)).alias("fixed_parent")))).alias("requests")))
    tree = old.agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("to", "round")))).alias("tree"))

    def climb(state, r):
        """Whether the walk up from the request's parent meets its category or goes round."""
        def step(w, _):
            there = state["tree"][w["node"]]
            over_ = w["hit"] | w["node"].isNull() | there.isNull()
            return F.when(over_, w).otherwise(F.struct(
                there["to"].alias("node"),
                (there["round"] | F.coalesce(there["to"] == r["target_id"], F.lit(False))).alias("hit")))
        start = F.struct(r["to"].alias("node"),
                         (r["round"] | F.coalesce(r["to"] == r["target_id"], F.lit(False))).alias("hit"))
        end = F.aggregate(F.sequence(F.lit(0), F.size(state["tree"])), start, step)
        return end["hit"] | F.coalesce(F.map_contains_key(state["tree"], end["node"]), F.lit(False))

    def decide(state, r):
        insert, patch, delete = (r["op"] == o for o in ("insert", "patch", "delete"))
        here = F.map_contains_key(state["tree"], r["target_id"])
        parent = r["parent_id"].isNull() | r["fixed_parent"] | F.map_contains_key(state["tree"], r["parent_id"])
        reason = F.coalesce(
            r["first"],
            F.when(insert & (r["old_target"] | F.array_contains(state["born"], r["target_id"])), "id_exists")
             .when(~insert & ~here, "not_found").when(~delete & ~parent, "parent_not_found")
             .when(r["walks"] & climb(state, r), "loop"))
        rest = F.map_filter(state["tree"], lambda k, _: k != r["target_id"])
        mine = F.create_map(r["target_id"], F.struct(r["to"].alias("to"), r["round"].alias("round")))
        return F.struct(
            F.when(reason.isNotNull(), state["tree"]).when(delete, rest).otherwise(F.map_concat(rest, mine)).alias("tree"),
            F.when(reason.isNull() & insert, F.array_append(state["born"], r["target_id"])).otherwise(state["born"]).alias("born"),
            F.array_append(state["said"], F.struct(r["seq"].alias("seq"), reason.alias("reason"))).alias("said"))
    empty = F.array().cast("array<struct<seq:bigint,reason:string>>")
    begin = F.struct(F.col("tree").alias("tree"), F.array().cast("array<bigint>").alias("born"), empty.alias("said"))
    said = (rows.select("requests", tree.scalar().alias("tree"))
            .select(F.explode(F.aggregate("requests", begin, decide)["said"]).alias("s")))
    return c.join(said.select("s.seq", "s.reason"), "seq")


def in_rounds(categories: DataFrame, c: DataFrame, old: DataFrame, edges: DataFrame) -> DataFrame:
    """All requests decided again and again from the last round's acceptances."""
    given, insert, delete = F.col("parent_id").isNotNull(), F.col("op") == "insert", F.col("op") == "delete"
    asks = cut_lineage(c.where("walks").select("seq", F.col("target_id").alias("goal")).join(
        edges.select(F.col("start").alias("seq"), F.col("to").alias("node"), "round"), "seq"))
    there = categories.select("id", F.lit(FIRST).cast("bigint").alias("born"), F.lit(None).cast("bigint").alias("dead"))
    # any first guess leads to the one result; with refused walkers the first walks meet no loop
    d = c.withColumn("reason", F.coalesce("first", F.when(F.col("walks"), "loop")))
    before = None
    while True:
        ok = d.where("reason is null")
        life = (there.unionByName(ok.where("op != 'patch'").select(
            F.col("target_id").alias("id"), F.when(insert, F.col("seq")).alias("born"), F.when(delete, F.col("seq")).alias("dead")))
            .groupBy("id").agg(F.min("born").alias("born"), F.min("dead").alias("dead")))

        def known(df, key, out):
            own_life = life.select(F.col("id").alias(key), F.col("born").alias("__b"), F.col("dead").alias("__d"))
            return (df.join(own_life, key, "left")
                    .withColumn(out, F.coalesce(F.col("__b") < F.col("seq"), F.lit(False)) & (
                        F.col("__d").isNull() | (F.col("__d") >= F.col("seq"))))
                    .withColumn(f"{out}_once", F.coalesce(F.col("__b") < F.col("seq"), F.lit(False))).drop("__b", "__d"))
        versions = cut_lineage(old.unionByName(edges.join(ok.select(F.col("seq").alias("start")), "start", "left_semi"))
                               .select("node", F.struct("start", "to", "round").alias("v")))
        loops = meeting(asks, versions).distinct().withColumn("__loop", F.lit(True))
        j = known(known(c, "target_id", "__t"), "parent_id", "__p").join(loops, "seq", "left")
        reason = F.coalesce("first", F.when(insert & F.col("__t_once"), "id_exists").when(~insert & ~F.col("__t"), "not_found")
                            .when(~delete & given & ~F.col("__p"), "parent_not_found").when(F.col("__loop"), "loop"))
        d = cut_lineage(j.select(*c.columns, reason.alias("reason")))
        now = d.agg(F.count("reason"), F.sum(F.xxhash64("seq", "reason").cast("decimal(38,0)"))).first()
        if now == before:
            return d
        before = now


def after(categories: DataFrame, decisions: DataFrame) -> DataFrame:
    """The category table after the accepted requests: a patch keeps the name
    unless it gives one and sets the parent (none given: cleared); children of a
    deleted category become roots."""
    ok = decisions.where("reason is null")
    gone = ok.where("op = 'delete'").select(F.col("target_id").alias("id")).distinct()
    last = (ok.where("op != 'delete'").groupBy(F.col("target_id").alias("id"))
            .agg(F.max(F.struct("seq", "parent_id")).alias("e"),
                 F.max(F.when(F.col("name").isNotNull(), F.struct("seq", "name"))).alias("n")))
    now = (categories.select("id", "name", "parent_id", F.lit(True).alias("__old")).join(last, "id", "full")
           .select("id", F.coalesce("n.name", "name").alias("name"),
                   F.when(F.col("e").isNotNull(), F.col("e.parent_id")).otherwise(F.col("parent_id")).alias("parent_id"))
           .join(gone, "id", "left_anti"))
    lost = gone.select(F.col("id").alias("parent_id"), F.lit(True).alias("__lost"))
    return (now.join(lost, "parent_id", "left")
            .select("id", "name", F.when(F.col("__lost").isNull(), F.col("parent_id")).alias("parent_id")))


def change_log(decisions: DataFrame, categories: DataFrame) -> DataFrame:
    """Activity rows of accepted inserts and deletes (the tracker logs no patch):
    the name is the one at that time."""
    ok = decisions.where("reason is null")
    names = (categories.select(F.col("id").alias("node"), F.struct(F.lit(FIRST).cast("bigint").alias("start"), "name").alias("v"))
             .unionByName(ok.where("op != 'delete' and name is not null")
                          .select(F.col("target_id").alias("node"), F.struct(F.col("seq").alias("start"), "name").alias("v"))))
    rows = as_of(ok.where("op != 'patch'").select("seq", F.col("target_id").alias("node"), "op", "name", "actor_id", "changed_at"),
                 names, "node", "seq", "v", "v")
    return rows.select("seq", F.col("actor_id").alias("user_id"),
                       F.when(F.col("op") == "insert", "create_category").otherwise("delete_category").alias("action"),
                       F.lit("category").alias("target_type"), F.col("node").alias("target_id"),
                       F.when(F.col("op") == "insert", F.col("name")).otherwise(F.col("v.name")).alias("target_name"),
                       F.col("changed_at").alias("created_at"))
