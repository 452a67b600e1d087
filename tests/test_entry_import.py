"""The entry module is read before any session exists."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
