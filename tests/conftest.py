"""One session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lexmill.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, spark__checkpoint__dir=f"file://{shared}")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
