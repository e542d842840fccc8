import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from vantage.session import build_session

    s = build_session("local[4]", app_name="vantage-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_tables(spark):
    from vantage.sources.fixture import load_fixture

    return load_fixture(spark)
