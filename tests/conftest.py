import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from lectern.session import local_session

    session = local_session(4, 4, "lectern-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
