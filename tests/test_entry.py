"""The entry module works whether or not the training-data folder is there."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_folder(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tracewell"), tmp_path / "tracewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(n[:2] for n in e.queries() if n.startswith('op')), 'pipeline' in e.queries(), len(e.oracle_sql()) > 50)"],
                          cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert said.stdout.split() == ["[]", "False", "True"], said.stderr


def test_queries_have_unique_sql():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
