import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from framelake.session import local_session

    session = local_session(8, partitions=4, memory="8g")
    yield session
    session.stop()


@pytest.fixture
def work(spark):
    """A function giving fresh paths in the session's work folder."""
    from framelake.session import work_path

    return lambda label="t": work_path(spark, label)
