import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("LEXGRAPH_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from lexgraph.session import get_session
    s = get_session("local[8]", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lexgraph-test-", dir="/tmp")


@pytest.fixture(scope="session")
def sf():
    return SF
