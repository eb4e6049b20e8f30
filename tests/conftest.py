import pytest

from lodeweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    return session
