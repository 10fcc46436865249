import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from muster.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="muster-tests", **{"spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rocks(spark):
    """A session of the same application whose streams keep state in RocksDB."""
    from muster.streaming.feed import ROCKSDB

    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


def rows(frame):
    """All rows of a small result as a sorted list of tuples."""
    return sorted((tuple(r) for r in frame.collect()), key=repr)
