import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from cardloom import session

    s = session.local_session("8", 4)
    session.ship(s)
    yield s
    s.stop()
