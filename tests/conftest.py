import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dielens.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("local[*]", 8)
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rows(spark):
    """Rows of tuples with a schema text to a DataFrame."""

    def make(schema, *tuples):
        return spark.createDataFrame(list(tuples), schema)

    return make
