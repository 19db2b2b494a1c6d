import os
import sys
from collections import Counter

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pricewright.runtime import session

    s = session("tests", cpus=4, **{"spark__sql__shuffle__partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as a multiset of tuples."""
    return lambda df: Counter(tuple(r) for r in df.collect())
