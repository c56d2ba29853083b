import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("PYTHONPATH", "")
ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ['PYTHONPATH']}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from corvane.session import local_session

    return local_session(4, partitions=4, memory="3g")


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    return DATA
