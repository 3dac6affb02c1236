import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from storyloom.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8, app_name="storyloom-tests")
    yield s


@pytest.fixture()
def tmp_out(tmp_path):
    return str(tmp_path)
