import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns whose names the operators use themselves
EXTRA = ("n_tokens string, labels string, kept string, score string, node string, n string, pos string, line string, "
         "host string, low string, label string, root string, bands string, word string, value string, kind string, "
         "w string, tok string, size string, drop string, t1 string, moved string")


def rows_of(texts, first=0):
    return [(first + i, t, "en", "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def benchmark():
    return duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet' order by item_id").fetchall()


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 997} alpha{i % 13}" for i in range(60_000))
    plain = "one two three four five six seven eight nine ten eleven twelve\nsecond line of this text here"
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "   \n\t ", None, "s", 5),
            (4, long, "en", "s", len(long)), (5, plain, "en", "s", 1), (5, plain, "en", "s", 1), (None, plain, "en", "s", 1),
            (6, plain, "de", "t", 1), (7, "\u0000 🙂 ▁ ñ", "en", "s", 7)]
    names = EXTRA.count(",") + 1
    return spark.createDataFrame([(*r, *["x"] * names) for r in rows], f"{DOC}, {EXTRA}")


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
