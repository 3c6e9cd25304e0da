import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from florilege.session import build, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build("local[4]", 2, spark__driver__memory="4g", spark__driver__host="127.0.0.1", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def middle():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
