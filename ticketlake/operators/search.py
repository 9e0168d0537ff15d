"""Duplicate-title search, for one title or a batch.

Single search: ``title ILIKE '%q%'`` (q unescaped, so ``%``/``_`` are
wildcards; fewer than 3 characters gives no rows), top 5 by counter.

Batch search without a cross join:

1. Per distinct note title keep its top 5 notes (``row_number <= 5`` over
   ``partitionBy(title)``, which Spark plans with a partial
   ``WindowGroupLimit`` before the shuffle, so a hot title ships at most 5
   rows per map task). The top 5 of a query are among the top 5s of the
   titles it matches.
2. Index distinct lower-cased titles by their 3-grams and 1-grams.
3. For each distinct query pick one key that every match must contain: its
   rarest literal 3-gram (no ``%``, ``_`` or ``\\`` inside), else its rarest
   literal character. Equi-join on that key, then verify with the exact
   ``ilike`` -- no candidate is dropped, no cap.
4. Queries made only of wildcards match by length alone (the number of
   ``_``); a class longer than the longest title matches nothing, so at most
   (longest title + 1) classes remain -- 256 for titles within their
   255-character rule -- and that side is broadcast after a size check.
5. Top 5 per query over the verified matches (again ``WindowGroupLimit``),
   then names of clients and categories for the result rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlake import schemas
from ticketlake.operators.filters import like_pattern, title_query_ok
from ticketlake.plans.joins import cut_lineage, within_broadcast_bound

TOP = 5
RESULT_COLS = ["id", "title", "counter", "status", "priority", "client_id", "category_id"]
_SPECIAL = "[%_\\\\]"  # regex class: % _ \


def _names(rows: DataFrame, clients: DataFrame, categories: DataFrame) -> DataFrame:
    cl = clients.select(F.col("id").alias("__cl"), F.col("name").alias("client_name"))
    ca = categories.select(F.col("id").alias("__ca"), F.col("name").alias("category_name"))
    return (rows.join(cl, F.col("client_id") == F.col("__cl"), "left")
            .join(ca, F.col("category_id") == F.col("__ca"), "left")
            .drop("__cl", "__ca", "client_id", "category_id"))


def title_search(notes, clients, categories, q: str) -> DataFrame:
    """GET /notes/search: top 5 title matches by counter (id breaks ties)."""
    from ticketlake.plans.joins import lookup_for_small
    if not title_query_ok(q):
        return _names(notes.select(*RESULT_COLS).where(F.lit(False)), clients, categories)
    top = cut_lineage(notes.where(F.ilike(F.col("title"), like_pattern(F.lit(q)))).select(*RESULT_COLS)
                      .orderBy(F.col("counter").desc(), F.col("id").asc()).limit(TOP))
    out = lookup_for_small(top, "client_id", clients, "id", {"name": "client_name"})
    out = lookup_for_small(out, "category_id", categories, "id", {"name": "category_name"})
    return out.drop("client_id", "category_id")


def _grams(text_col, n: int):
    """Array of the n-grams of a string (empty when shorter than n)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text_col) - (n - 1), F.lit(0))),
                       lambda i: F.substring(text_col, i, n))


def _title_keys(titles: DataFrame) -> DataFrame:
    """(title, key) for every distinct 3-gram ('3:abc') and character ('1:a')."""
    lt = F.lower(F.col("title"))
    keys = F.array_union(
        F.transform(F.filter(_grams(lt, 3), lambda g: F.length(g) == 3), lambda g: F.concat(F.lit("3:"), g)),
        F.transform(F.filter(_grams(lt, 1), lambda g: F.length(g) == 1), lambda g: F.concat(F.lit("1:"), g)))
    return titles.select("title", F.explode(F.array_distinct(keys)).alias("key"))


def title_search_batch(notes, clients, categories, candidates: DataFrame, top: int = TOP) -> DataFrame:
    """For every candidate ``(cand_id, q)``: its top ``top`` existing notes by
    counter whose title contains q (ILIKE semantics). Columns: cand_id, q,
    match_rank, and the note's id, title, counter, status, priority,
    client_name, category_name."""
    # 1. per-title top-k
    per_title = Window.partitionBy("title").orderBy(F.col("counter").desc(), F.col("id").asc())
    # computed once (one scan of notes), read by the four branches below
    title_top = cut_lineage(notes.select(*RESULT_COLS).withColumn("__rn", F.row_number().over(per_title))
                            .where(F.col("__rn") <= top).drop("__rn"))
    titles = title_top.select("title").distinct()
    # 2. key index over distinct titles, with key frequencies
    tkeys = _title_keys(titles)
    freq = tkeys.groupBy("key").agg(F.count(F.lit(1)).alias("freq"))
    # 3. distinct valid queries and the rarest literal key of each
    queries = (candidates.select("q").where(F.length("q") >= schemas.SEARCH_MIN_CHARS).distinct()
               .withColumn("lq", F.lower("q")))
    q3 = F.transform(F.filter(_grams(F.col("lq"), 3), lambda g: ~g.rlike(_SPECIAL) & (F.length(g) == 3)),
                     lambda g: F.concat(F.lit("3:"), g))
    q1 = F.transform(F.filter(_grams(F.col("lq"), 1), lambda g: ~g.rlike(_SPECIAL) & (F.length(g) == 1)),
                     lambda g: F.concat(F.lit("1:"), g))
    # wildcards made plain by a backslash, for queries without any other plain character
    escaped = F.transform(F.regexp_extract_all("lq", F.lit(r"(?s)\\(.)"), 1), lambda g: F.concat(F.lit("1:"), g))
    qkeys = queries.select("q", F.explode(F.when(F.size(q3) > 0, q3).when(F.size(q1) > 0, q1).otherwise(escaped))
                           .alias("key"))
    # a query whose key never occurs in any title has no match: inner join drops it, which is exact
    chosen = (qkeys.join(freq, "key").groupBy("q")
              .agg(F.min_by("key", F.struct("freq", "key")).alias("key")))
    keyed = (chosen.join(tkeys, "key").select("q", "title")
             .where(F.ilike(F.col("title"), like_pattern(F.col("q")))))
    # 4. wildcard-only queries: matches depend on the number of '_' only (<= 256 classes)
    wild = (queries.where(~F.col("lq").rlike("[^%_]"))
            .withColumn("u", F.length(F.regexp_replace("q", "%", ""))))
    longest = titles.select(F.max(F.length("title"))).scalar()
    classes = cut_lineage(wild.select("u").distinct().where(F.col("u") <= longest))
    small = within_broadcast_bound(classes)
    by_len = (titles.join(F.broadcast(classes) if small else classes, F.length("title") >= F.col("u"))
              .join(wild, "u").select("q", "title"))
    matched = keyed.unionByName(by_len)
    # 5. top-k per query over the matched titles' top-k rows
    per_q = Window.partitionBy("q").orderBy(F.col("counter").desc(), F.col("id").asc())
    hits = (matched.join(title_top, "title")
            .withColumn("match_rank", F.row_number().over(per_q))
            .where(F.col("match_rank") <= top))
    hits = _names(hits, clients, categories)
    return (candidates.select("cand_id", "q").join(hits, "q")
            .select("cand_id", "q", F.col("match_rank").cast("bigint").alias("match_rank"),
                    "id", "title", "counter", "status", "priority", "client_name", "category_name"))
