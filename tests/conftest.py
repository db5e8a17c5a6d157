import pytest

from notelake.sources.scratch import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", "local[4]", 4)
