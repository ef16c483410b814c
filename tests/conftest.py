import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session
    s = get_session("local[8]", 8, driver_memory="8g")
    yield s


@pytest.fixture(scope="session")
def con():
    from oracle_compare import SF_SMALL, duck
    return duck(SF_SMALL)
