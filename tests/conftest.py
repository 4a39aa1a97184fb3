import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from boxline.sources.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("boxline-tests", cores="8", shuffle_partitions=4, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    return session
