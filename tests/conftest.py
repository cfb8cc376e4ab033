import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riverframe.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
