import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("REPOLENS_SCRATCH", tempfile.mkdtemp(prefix="repolens-test-"))
    from repolens.session import get_spark
    s = get_spark("repolens-tests", master=os.environ.get("TEST_MASTER", "local[4]"), shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="repolens-case-", dir=os.environ.get("REPOLENS_SCRATCH"))
