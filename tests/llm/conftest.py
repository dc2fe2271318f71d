import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Builds a documents table of (doc_id, text) pairs, with the other columns and some whose names clash."""

    def build(pairs, extra=False):
        df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs], SCHEMA)
        return df.selectExpr("*", "1 AS keep_id", "'x' AS content", "2 AS component_id", "3 AS n") if extra else df

    return build
