import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# the workers of operators that are called directly find the package here
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyweave.session import local_session

    session = local_session(4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
