"""The entry points with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_other_queries_stay_where_a_library_is_missing():
    code = ("import sys; sys.modules['xxhash'] = None\n"
            "import __spark_entry__ as e\nfrom wardfield import catalog as c\n"
            "assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.SQL)")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    assert "without the training-data operators" in done.stderr


def test_nothing_else_imports_the_operators():
    code = ("import sys; sys.modules['wardfield.llm'] = None\n"
            "from wardfield import catalog\nfrom wardfield.plans import study\nfrom wardfield.operators import graph_tree, extremes, spatial, tiles\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
