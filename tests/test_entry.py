"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
sys.modules["graphloom.llm"] = None
import __spark_entry__ as e
assert "mga" in e.queries() and not any(n.startswith("op") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_stands_alone():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_engine_does_not_import_the_subpackage():
    for path in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "graphloom.llm" not in path.read_text(), path
