import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from harness import make_session
    session = make_session(os.environ.get("TEST_CPUS", "8"))
    yield session
    session.stop()
