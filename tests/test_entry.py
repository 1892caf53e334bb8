"""The driver's entry without the training-data part, or with a library of it missing."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
CODE = """
import sys, warnings
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
names = set(entry.queries())
assert "topology_flagship" in names and set(entry.oracle_sql()) <= names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert any("left out" in str(w.message) for w in told)
"""


@pytest.mark.parametrize("name", ["corpus_pipeline", "strandlake.llm", "public_tokenizers", "xxhash"])
def test_the_core_stands_alone(name):
    done = subprocess.run([sys.executable, "-c", CODE.format(name=name)], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
