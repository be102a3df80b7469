import os
import shutil
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("STEMMA_DRIVER_MEMORY", "4g")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stemma.session import get_spark

    shared = tempfile.mkdtemp(prefix="stemma-test-")
    s = get_spark("local[8]", 4, **{"spark.checkpoint.dir": "file://" + shared, "spark.sql.warehouse.dir": shared + "/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(shared, ignore_errors=True)


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA
