"""The entry points stand on their own, whatever is missing of the training-data part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {0!r} or name.startswith({0!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(len(e.queries()), any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in e.queries()))
"""


@pytest.mark.parametrize("name", ["framelake.llm", "corpus_pipeline", "xxhash", "public_tokenizers"])
def test_core_without(name):
    out = subprocess.run([sys.executable, "-c", HIDE.format(name)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1] == "False"


def test_faults_of_the_library_are_not_hidden():
    assert subprocess.run([sys.executable, "-c", HIDE.format("framelake.operators")], cwd=ROOT, capture_output=True, check=False).returncode
