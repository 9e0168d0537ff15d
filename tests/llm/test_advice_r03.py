"""Cases that reviews of the operators found."""

import re

import numpy as np

from tests.llm.conftest import DOC, rows_of
from tests.llm.test_brute import copies
from ticketlake.llm import bagminhash as near
from ticketlake.llm import line_templates, pii


def test_op10_rows_of_numbers_stay(spark):
    texts = ["5 6 7 8\n12 34 56 78\nabc", "99 11 22 33\ndef", "2021-01-05 10:11 4.5 77\nghi", "12 34 56 78\njkl"]
    got = {r.doc_id: r.text for r in line_templates.without_recurring(spark.createDataFrame(rows_of(texts), DOC)).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: texts[2], 3: "jkl"}


def test_helper_columns_do_not_clash(spark):
    names = ["__text__", "__gone__", "__t1__", "__T2__", "__drop__", "__node__", "__key__", "__n__", "___node___"]
    docs = spark.createDataFrame([(*r, *names) for r in rows_of(["a b c d e f\nx", "a b c d e f\nx", "a b c d e f\ny"])],
                                 DOC + ", " + ", ".join(f"{n} string" for n in names))
    for got in (near.one_of_each(docs), line_templates.without_recurring(docs)):
        assert got.columns == docs.columns
        assert all([r[n] for n in names] == names for r in got.collect())
    assert near.one_of_each(docs).count() == 2


def test_op9_pairs_grow_with_nodes(spark, monkeypatch):
    """A group of near copies takes few more comparisons than it has texts, however large it is."""
    seen = []
    real = near.verified

    def counted(pairs, texts):
        seen.append(pairs.distinct().count())
        return real(pairs, texts)
    monkeypatch.setattr(near, "verified", counted)
    per = []
    for n in (120, 480):
        seen.clear()
        texts = copies(np.random.default_rng(n), n, 120, 2)
        got = near.classes(spark.createDataFrame(rows_of(texts), DOC)).collect()
        assert {r.class_id for r in got if r.class_size > 1} <= {0, *range(n + 1)}
        per.append(sum(seen) / n)
    assert per[0] < 4 and per[1] < 1.3 * per[0] + 0.5


def test_op5_names_without_a_title_and_keys(spark):
    text = "Mr Peter Miller came. Peter Miller said hi to Peter Millers. Dr Andrea Rossi, Mr Andrea Rossi, Andrea Rossi."
    docs = spark.createDataFrame(rows_of([text]), DOC)
    out = pii.anonymised(docs).first().text
    assert "Peter Miller " not in out and "Peter Millers" in out and "Andrea" not in out and "Rossi" not in out
    one, two = re.findall(r"(?:Mr|Dr) (\w+ \w+)", out)[:2]
    assert out.count(one) == 2 and out.count(two) == 3
    assert pii.anonymised(docs).first().text == out
    assert pii.anonymised(docs, b"k1").first().text != pii.anonymised(docs, b"k2").first().text
