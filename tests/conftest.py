import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, app_name="corpusloom-tests")
    yield s
    s.stop()
