import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stagecraft.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "8", 4)


@pytest.fixture
def rows(spark):
    """rows(data, ddl) -> DataFrame"""
    return lambda data, ddl: spark.createDataFrame(data, ddl)


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def collected():
    return as_set
