import pytest

from skein.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]")
    yield s
    s.stop()
