import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("WARDLINE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from wardline.session import local_session

    s = local_session(4, 4)
    yield s
    s.stop()
