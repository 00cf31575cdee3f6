import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Column values of expressions over one-row or many-row literals."""

    def run(df, *columns):
        return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]

    return run
