import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from traitscope.session import get_spark, ship_package

    session = get_spark("tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session, os.path.join(ROOT, "tests"))
    return session


@pytest.fixture(scope="session")
def folder():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
