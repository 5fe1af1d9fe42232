import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from piste.session import local_session

    s = local_session("*", shuffle_partitions=8, app="piste-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark, tmp_path):
    """A fresh folder per test under the session's checkpoint root (test-only default)."""
    import uuid

    from piste.session import checkpoint_root

    return f"{checkpoint_root(spark)}/tests-{uuid.uuid4().hex}"
