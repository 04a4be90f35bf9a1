"""The entry module with and without the optional subpackage."""

import subprocess
import sys

HIDE = "import sys; sys.modules['kpiframe.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
CODE = ("import __spark_entry__ as E\nfrom kpiframe.plans.catalog import ORACLE, REGISTRY\n"
        "assert E.queries() == REGISTRY and E.oracle_sql() == ORACLE\n")


def test_entry_works_without_the_subpackage():
    subprocess.run([sys.executable, "-c", HIDE + CODE], check=True)


def test_a_broken_import_is_not_hidden():
    broken = "import sys; sys.modules['numpy'] = None\nimport __spark_entry__\n"
    run = subprocess.run([sys.executable, "-c", broken], capture_output=True, text=True)
    have_llm = subprocess.run([sys.executable, "-c", "import kpiframe.llm"], capture_output=True).returncode == 0
    assert (run.returncode != 0) == have_llm
