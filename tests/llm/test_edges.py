"""Every operator on empty tables and on the rows of ``edges``."""

import public_tokenizers
import pytest

from ticketlake.llm import (bagminhash, decontamination, licenses, line_templates, pii, quality_knn, quality_rules,
                            secret_scan, sentencepiece_bpe, site_style)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BENCH = "item_id long, text string, doc_id string, score string"


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None), (6, 1, 1), (6, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (None, "two three four five six seven", "", ""),
                                  (3, "word5 alpha5 word6 alpha6 word7 alpha7 word8 alpha8 word9", "", ""),
                                  (3, "word5 alpha5 word6 alpha6 word7 alpha7 word8 alpha8 word9", "", "")], BENCH)


PER_ROW = {
    "op1": lambda s, d: sentencepiece_bpe.encode_decode(d, MODEL),
    "op1_ids": lambda s, d: sentencepiece_bpe.encoded(d, MODEL),
    "op2": lambda s, d: licenses.scan(d),
    "op4": lambda s, d: quality_rules.assess(d, quality_rules.learn(d, labels(s))),
    "op5": lambda s, d: pii.anonymised(d),
    "op6": lambda s, d: quality_knn.score(d, labels(s)),
    "op9": lambda s, d: bagminhash.classes(d),
    "op10": lambda s, d: line_templates.without_recurring(d),
}
OTHERS = {
    "op3": lambda s, d: secret_scan.scan(d),
    "op4_passed": lambda s, d: quality_rules.passed(d, None),
    "op8": lambda s, d: decontamination.overlaps(d, bench(s)),
    "op8_clean": lambda s, d: decontamination.clean(d, bench(s)),
    "op9_one": lambda s, d: bagminhash.one_of_each(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_rows_stay(spark, edges, name):
    assert PER_ROW[name](spark, edges).count() == edges.count()
    assert PER_ROW[name](spark, edges.limit(0)).count() == 0


@pytest.mark.parametrize("name", OTHERS)
def test_runs(spark, edges, name):
    got = OTHERS[name](spark, edges)
    assert OTHERS[name](spark, edges.limit(0)).count() == 0
    if name in ("op4_passed", "op8_clean", "op9_one"):
        assert got.columns == edges.columns
    got.collect()


def test_results_of_empty_texts(spark, edges):
    empty = [None, 1, 2]
    got = {r.doc_id: r for r in PER_ROW["op1"](spark, edges.where("text is null or text = ''")).collect()}
    assert set(got) == set(empty) and all(r.n_tokens == 1 for r in got.values())
    row = licenses.scan(edges.where("doc_id = 1")).first()
    assert (row.n_words, row.n_base, row.first_word, row.labels, row.score) == (0, 0, None, "", 0.0)
    row = quality_rules.assess(edges.where("doc_id = 2"), None).first()
    assert row.base_failed and not row.kept and row.n_words == 0
    row = pii.anonymised(edges.where("doc_id = 1")).first()
    assert row.text is None and row.n_entities == 0
    assert line_templates.without_recurring(edges.where("doc_id = 1")).first().text is None


def test_near_duplicates_of_edges(spark, edges):
    got = bagminhash.classes(edges).collect()
    same = {r.class_id for r in got if r.doc_id in (5, 6)}
    assert same == {5}
    assert {r.class_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = bagminhash.one_of_each(edges).collect()
    assert sum(r.text is not None and r.text.startswith("one two") for r in kept) == 1
    assert len(kept) == len({r.class_id for r in got})


def test_contaminated_edges(spark, edges):
    got = decontamination.overlaps(edges, bench(spark)).collect()
    assert {r.doc_id for r in got} == {4, 5, 6, None}
    assert {r.doc_id for r in decontamination.clean(edges, bench(spark)).collect()} == {None, 1, 2, 3, 7}
    none = spark.createDataFrame([], BENCH)
    assert decontamination.overlaps(edges, none).count() == 0
    assert decontamination.clean(edges, none).count() == edges.count()


def test_pages(spark):
    rows = [(None, None, None, "x"), (1, "nonsense", "", "x"), (2, "http://a.b/c", "<p>t &amp; u", "x"),
            (2, "http://a.b/c", "<p>t &amp; u", "x"),
            (3, "http://a.b/d", "<article><p>" + "long text " * 50_000 + "</article><nav>menu</nav>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in site_style.main_text(pages).collect()}
    assert (got[None].text, got[None].n_chars, got[1].text) == ("", 0, "")
    assert got[2].text == "t & u" and got[3].n_chars == 50_000 * 10 - 1
    assert site_style.main_text(pages).count() == 5
    assert site_style.main_text(pages.limit(0)).count() == 0
