import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldscan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", app="tests", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Values as flat rows of a field whose name says nothing."""

    def make(values, path="ref"):
        return spark.createDataFrame([(i, path, v) for i, v in enumerate(values)], "id int, field_path string, value string")

    return make
