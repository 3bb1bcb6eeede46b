import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from kvern.session import local_session

    session = local_session(cpus=8, shuffle_partitions=8, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    yield session
    session.stop()
