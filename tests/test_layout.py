"""The library stands without the training-data subpackage: queries, SQL and imports work when both its folders are gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 100 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= set(names)
"""


def test_without_training_data(tmp_path):
    own = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md")
    shutil.copytree(ROOT, own, ignore=skip)
    assert not (own / "claimgraph" / "llm").exists() and (own / "corpus_pipeline.py").exists()
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", CODE], cwd=own, env=os.environ | {"PYTHONPATH": str(own)}, check=True)
        (own / "corpus_pipeline.py").unlink(missing_ok=True)


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "claimgraph")):
        for name in files:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), f"{folder}/{name}"
