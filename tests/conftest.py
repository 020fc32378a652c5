from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from orefall.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, partitions=4, app="tests", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(shared / "warehouse")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
