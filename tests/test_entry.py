import sys

import __spark_entry__ as entry


def test_queries_and_sql_agree_on_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    import subprocess

    code = "import pagewarrant.plans, sys; sys.exit(any(m.startswith('pagewarrant.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry._HERE).returncode == 0
