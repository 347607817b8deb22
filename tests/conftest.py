from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from relaycast.session import local_session, with_workers

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return with_workers(session)


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return os.environ.get("TEST_SF_DIR", str(SF))
