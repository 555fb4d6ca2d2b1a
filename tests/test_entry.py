"""The entry module stands without the folders for training data."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("millrace.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"], list(e.queries())
assert len(e.queries()) >= 40 and set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_training_data_folders():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_statements_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["category", "avg_stars", "n"] and frame.count() == 10
