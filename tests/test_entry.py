"""The entry point can be imported and listed before there is a session, and its oracle keys name queries."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["day", "avg_value", "hit_pct", "n"]
