import pytest
from opslake.llm.common import prepare


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) pairs, with a column whose name may clash."""

    def make(rows, schema="doc_id long, text string, n_hit string, row string"):
        prepare(spark)
        return spark.createDataFrame([(*r, "x", None) for r in rows], schema)

    return make
