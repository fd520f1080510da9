import pytest

from tabloom.session import local_session


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: fits models at full size")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
