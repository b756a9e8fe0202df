import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture
def no_broadcast(spark):
    """Forces every join onto the shuffled, salted path."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)
