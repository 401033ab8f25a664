import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerloom.session import local_session

    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("8", 4, **{"spark.checkpoint.dir": shared, "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named values."""
    from pyspark.sql import functions as F

    def evaluate(expression, **values):
        row = spark.range(1).select(*[
            (F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v])).alias(k) for k, v in values.items()
        ])
        return row.select(expression.alias("result")).first()[0]

    return evaluate
