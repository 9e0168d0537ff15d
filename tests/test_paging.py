from pyspark.sql import functions as F

from ticketlake.functions.paging import paginate, parse_int
from ticketlake.operators import lists
from ticketlake.operators.filters import NoteQuery


def test_paginate_rules():
    assert paginate(None, None) == paginate(1, 20)
    assert paginate("0", "0").limit == 20 and paginate("0", "0").page == 1
    assert paginate("-3", "500").page == 1 and paginate("-3", "500").limit == 100
    assert paginate("2abc", "x").page == 2 and paginate("2abc", "x").limit == 20
    assert paginate(3, 200).offset == 200
    assert parse_int("  7 ") == 7 and parse_int("abc") is None


def test_all_pages_equal_sorted_set(tables):
    """Pages joined = the sorted filtered set: no gaps, no repeats."""
    q = NoteQuery(priority="High")
    total = lists.notes_count(tables.notes, q).first().total
    limit = 100
    seen = []
    for page in range(1, total // limit + 2):
        rows = lists.notes_page(tables.notes, tables.clients, tables.users, tables.categories, q,
                                paginate(page, limit))
        seen += [r.id for r in rows.orderBy(F.col("updated_at").desc(), F.col("id").desc()).collect()]
    expect = [r.id for r in tables.notes.where(q.predicate())
              .orderBy(F.col("updated_at").desc(), F.col("id").desc()).select("id").collect()]
    assert seen == expect and len(set(seen)) == total


def test_keyset_equals_offset_paging(tables):
    q = NoteQuery(status="Resolved")
    p1 = lists.notes_page(tables.notes, tables.clients, tables.users, tables.categories, q, paginate(1, 25))
    u, i = lists.last_key_of(p1)
    k2 = lists.notes_after_key(tables.notes, tables.clients, tables.users, tables.categories, q, u, i, 25)
    o2 = lists.notes_page(tables.notes, tables.clients, tables.users, tables.categories, q, paginate(2, 25))
    assert sorted(r.id for r in k2.collect()) == sorted(r.id for r in o2.collect())
