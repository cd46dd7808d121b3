import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from netfusion.session import get_session

    session = get_session("tests", cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
