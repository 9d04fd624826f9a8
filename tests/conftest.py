import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from crowdrank.session import build_session

    s = build_session("local[4]", app_name="crowdrank-tests", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        # Tests only: a session without a shared folder gets its own.
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="crowdrank-test-ckpt-"))
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
