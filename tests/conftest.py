import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from envspark.session import get_spark

    s = get_spark("local[4]", app="envspark-tests", shuffle_partitions=8, extra={"spark.driver.memory": "4g"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="envspark-tests-", dir="/tmp"))
    yield s


@pytest.fixture(scope="session")
def fixture_dir():
    from fixtures import write_all

    root = tempfile.mkdtemp(prefix="envspark-fx-", dir="/tmp")
    return write_all(root), root
