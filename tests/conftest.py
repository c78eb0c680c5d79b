import pytest

from tests.helpers import session


@pytest.fixture(scope="session")
def spark():
    return session()
