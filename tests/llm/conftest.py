import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), "x", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, payload string, key int")

    return make
