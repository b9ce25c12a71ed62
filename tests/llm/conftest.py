import duckdb
import pytest

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the smallest documents table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture
def docs(spark):
    """Makes a documents table: rows of (doc_id, text[, source]), with columns
    whose names clash with those of operators."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 7, "x", True, 1.5, [1]) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "size long, fp string, kept boolean, target double, ids array<int>")

    return make
