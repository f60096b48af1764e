import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from harness import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(os.environ.get("TEST_CPUS", "8"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
