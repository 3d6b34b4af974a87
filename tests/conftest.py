import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slatewise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.sql.autoBroadcastJoinThreshold": "10MB"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
