from __future__ import annotations

import subprocess
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_of_sql_are_names_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['veilscan.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
