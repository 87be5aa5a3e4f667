"""The driver's entry points are there without a session."""

import subprocess
import sys


def test_entry_points_import_without_spark():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 200 and callable(e.entry)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
