import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import TEXTS, table  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """All awkward texts; two rows are there twice."""
    return table(spark, TEXTS + [TEXTS[4], TEXTS[7]]).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, TEXTS).where("false")
