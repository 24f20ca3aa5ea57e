import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from small import corpus, frame  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [(1, "x")]).filter("doc_id < 0")
