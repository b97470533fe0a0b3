import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from recsift.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, driver_memory="4g", app="recsift-tests")
    yield s
    s.stop()


IX_SCHEMA = "user_id string, parent_asin string, rating double, timestamp long, seq long"


@pytest.fixture
def ix(spark):
    def make(rows):
        rows = [(*r, i) if len(r) == 4 else r for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, IX_SCHEMA)
    return make
