import pytest

from heddle.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(master="local[4]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session
