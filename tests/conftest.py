from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("BENCH_DRIVER_MEMORY", "4g")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from millrace import session

    s = session.build("tests", cores=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).is_dir():
        pytest.skip("test tables are not here")
    return SMALL
