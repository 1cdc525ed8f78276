import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strikelens.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture
def short_slices(spark):
    """Slices of a minute, so that small tapes have many."""
    spark.conf.set("strikelens.sliceSeconds", "60")
    yield
    spark.conf.unset("strikelens.sliceSeconds")


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(value) if isinstance(value, list) else value


@pytest.fixture
def rows():
    """The rows of a result in a fixed order, floats rounded."""

    def collect(df):
        found = df.select(*sorted(df.columns)).collect()
        return sorted((tuple(_plain(v) for v in r) for r in found), key=str)

    return collect
