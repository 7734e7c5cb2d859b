from __future__ import annotations

import pytest

from .session import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session(cores=4, partitions=4)
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Rows ``(id, text)`` from a list of strings, over several partitions."""

    def build(values):
        rows = list(enumerate(values))
        return spark.createDataFrame(rows, "id bigint, text string").repartition(3)

    return build


@pytest.fixture
def apply(texts):
    """Results of a ``Column -> Column`` function for a list of strings, in their order."""

    def run(fn, values):
        from pyspark.sql import functions as F

        rows = texts(values).select("id", fn(F.col("text")).alias("r")).collect()
        return [r["r"] for r in sorted(rows, key=lambda r: r["id"])]

    return run
