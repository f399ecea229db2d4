import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from folioscope.session import get_session

    return get_session("tests", cpus=4, shuffle=4)


@pytest.fixture
def frame(spark):
    """A small DataFrame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
