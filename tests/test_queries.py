"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_all_queries():
    r = subprocess.run([sys.executable, "compare.py", "--sf", DATA], cwd=ROOT, capture_output=True, text=True, timeout=1500)
    assert r.returncode == 0, "\n".join(x for x in r.stdout.splitlines() if "DIFFERS" in x or "FAILED" in x or "only" in x)
