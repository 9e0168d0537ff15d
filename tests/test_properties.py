"""Property tests against brute force on small random fixtures."""

import random

import duckdb
from pyspark.sql import functions as F

from ticketlake.operators.changes import floored_counts
from ticketlake.operators.search import title_search_batch


def test_batch_search_equals_brute_force_ilike(spark):
    rnd = random.Random(3)
    alphabet = "abAB c_%"
    titles = ["".join(rnd.choice("abcAB ") for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    notes = spark.createDataFrame(
        [(i, t, rnd.randint(1, 4), "Open", "Low", 1, None) for i, t in enumerate(titles)],
        "id long, title string, counter int, status string, priority string, client_id long, category_id long")
    queries = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(3, 5))) for _ in range(60)]
    queries += ["%%%", "___", "_%_", "abc", "ABC", "a_b"]
    cands = spark.createDataFrame(list(enumerate(queries)), "cand_id long, q string")
    empty = spark.createDataFrame([], "id long, name string")
    got = sorted((r.cand_id, r.match_rank, r.id)
                 for r in title_search_batch(notes, empty, empty, cands).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE n(id BIGINT, title VARCHAR, counter INT)")
    con.executemany("INSERT INTO n VALUES (?, ?, ?)", [(i, t, r["counter"]) for i, t, r in
                                                       zip(range(len(titles)), titles,
                                                           [row.asDict() for row in notes.orderBy("id").collect()])])
    con.execute("CREATE TABLE c(cand_id BIGINT, q VARCHAR)")
    con.executemany("INSERT INTO c VALUES (?, ?)", list(enumerate(queries)))
    expect = sorted(con.execute("""
        SELECT cand_id, rn, id FROM (
          SELECT c.cand_id, n.id, row_number() OVER (PARTITION BY c.cand_id ORDER BY n.counter DESC, n.id) AS rn
          FROM c JOIN n ON n.title ILIKE '%' || c.q || '%' WHERE length(c.q) >= 3) WHERE rn <= 5""").fetchall())
    assert got == expect


def test_floored_counts_equal_sequential(spark):
    rnd = random.Random(11)
    clients = spark.createDataFrame([(i,) for i in range(20)], "id long")
    start = {i: rnd.randint(0, 3) for i in range(20)}
    deltas = [(rnd.randrange(20), s, rnd.choice([1, -1, -1])) for s in range(400)]
    got = {r.client_id: r.notes_count for r in floored_counts(
        clients, spark.createDataFrame(list(start.items()), "client_id long, x0 long"),
        spark.createDataFrame(deltas, "client_id long, seq long, delta long")).collect()}
    expect = dict(start)
    for c, _, d in sorted(deltas, key=lambda x: x[1]):
        expect[c] = max(expect[c] + d, 0)
    assert got == expect
