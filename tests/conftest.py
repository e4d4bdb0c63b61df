import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from peerskill.session import get_session

    s = get_session(master="local[4]", shuffle_partitions=4, app="peerskill-tests")
    yield s


SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def short_trainings():
    """Trainings of at most 20 rounds; the queries run the configured ones."""
    from peerskill.operators import models

    models.ROUNDS_CAP = 20
