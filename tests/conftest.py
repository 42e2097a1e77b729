import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from glyphmill.session import local_session

    s = local_session("tests", partitions=4)
    s.sparkContext.setLogLevel("OFF")
    yield s


@pytest.fixture(scope="session")
def small():
    """The smallest data directory; tests that need it are skipped without it."""
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    return d
