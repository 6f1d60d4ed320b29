import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ringweave.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not Path(SMALL).exists():
        pytest.skip("test tables are not on this machine")
    return SMALL
