import pytest

from cinelake.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def sample(shipped):
    return shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def make(shipped):
    """Documents from (id, text) pairs, with columns whose names clash with those of results."""

    def build(rows, **extra):
        df = shipped.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        return df.selectExpr("*", "'x' AS score", "1 AS kept", "'y' AS spans", "2 AS component_id", "3 AS row", "'z' AS id", "0 AS key")

    return build
