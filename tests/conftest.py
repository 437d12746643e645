import tempfile

import pytest
from pyspark.sql import functions as F

from feedloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "tests", "8", **{"spark.sql.maxMetadataStringLength": "5000", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-")}
    )
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """The value of an expression over one column ``x``, for each input."""

    def run(build, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r.y for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
