import os
import sys

os.environ["TZ"] = "UTC"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest  # noqa: E402

from quillgraph.plans.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build("local[4]", 4, "4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
