import pytest

EXTRA = ", score double, t string, id bigint, key string"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1.0, "x", 7, "k") for r in rows]
        ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint" + EXTRA
        return spark.createDataFrame(full, ddl)

    return make


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
