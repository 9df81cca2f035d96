import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from techpub_spark.session import local_session

    s = local_session("tests", cores=4, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
