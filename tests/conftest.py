import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.util import make_spark


@pytest.fixture(scope="session")
def spark():
    s = make_spark()
    yield s
    s.stop()
