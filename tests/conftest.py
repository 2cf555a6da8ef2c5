import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corvelo.session import local_session, share_package

    session = local_session(4, partitions=4, memory="4g", name="tests")
    session.sparkContext.setLogLevel("ERROR")
    share_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
