import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from harness import make_spark

    session = make_spark()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
