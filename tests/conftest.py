import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sprout.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", 4, app="sprout-tests")
    ensure_checkpoint_dir(s)  # unset in tests -> a local scratch folder
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="sprout-test-", dir="/tmp")
