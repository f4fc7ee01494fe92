from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_and_registry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_works_without_the_subpackage():
    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; assert e.llm_queries is None and 'p4_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, check=False).returncode == 0


def test_core_does_not_name_the_subpackage():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "millrace").parts:
            assert "millrace.llm" not in path.read_text(), path
