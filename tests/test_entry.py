"""The entry where the corpus subpackage cannot be imported."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
print(len(e.queries()))
"""


@pytest.mark.parametrize("names", [("zstandard",), ("xxhash", "tokenizers"), ("notelake.llm", "corpus_pipeline")])
def test_other_queries_stay(names):
    from notelake.plans.registry import QUERIES

    done = subprocess.run([sys.executable, "-c", SCRIPT.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(QUERIES)
