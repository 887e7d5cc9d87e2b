"""One small session for all tests."""

import pytest

from parlance.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()
