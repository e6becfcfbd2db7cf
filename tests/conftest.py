import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return s
