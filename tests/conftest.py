from __future__ import annotations

import pytest

from tests.session import session

SF_TINY = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture
def workspace(spark):
    from tidemark.workspace import Workspace

    return Workspace(spark)


@pytest.fixture(scope="session")
def sales(spark):
    """The small fixture, written once for all tests of the session."""
    from tidemark.plans import fixtures
    from tidemark.workspace import Workspace

    return Workspace(spark).stage(fixtures.sales(spark, SF_TINY), "sales")
