import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """documents(doc_id, text, lang, source, n_chars) with a column whose name clashes with results."""
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS score", "'y' AS `rank`")
