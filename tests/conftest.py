import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from websift.session import build_session
    s = build_session(cpus="*", shuffle_partitions=8, driver_memory="8g", app="websift-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="websift-test-ckpt-"))
    yield s
    s.stop()
