import pytest

#: Columns that clash with names the operators use inside.
CLASH = ", rid string, doc string, fp string, row string, count string, rank string, kept string, h string, spans string"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *["x"] * 9) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + CLASH)

    return make


def pytest_collection_modifyitems(items):
    for item in items:
        if "tests/llm" in str(item.fspath):
            item.add_marker("llm")
