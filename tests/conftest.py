import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from effectspark.session import local_session  # noqa: E402
from effectspark.sources.store import Workspace  # noqa: E402

TESTDATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="effectspark-tests")
    yield session
    session.stop()


@pytest.fixture()
def ws(spark):
    workspace = Workspace(spark)
    yield workspace
    workspace.drop()


@pytest.fixture(scope="session")
def table_names():
    return TABLES


@pytest.fixture(scope="session")
def tiny():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{TESTDATA}/sf0.01"
