from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hubflow.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """A small table from rows and a type text; short rows are filled with nulls."""

    def make(ddl: str, *rows: tuple):
        width = len(ddl.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], ddl)

    return make
