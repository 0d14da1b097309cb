import subprocess
import sys

from conftest import ROOT


def test_the_entry_module_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and callable(e.entry)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
