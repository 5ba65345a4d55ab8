"""The driver's entry points must be readable without a session."""

import subprocess
import sys


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 90; print(len(q))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip().isdigit()
