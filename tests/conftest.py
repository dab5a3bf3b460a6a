import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from opslake import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluate one column expression on one row of literals."""

    def evaluate(expr, **values):
        schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
        row = [tuple(v for _, v in values.values()) or (1,)]
        return spark.createDataFrame(row, schema).select(expr).first()[0]

    return evaluate
