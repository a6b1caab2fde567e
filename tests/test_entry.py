"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_subpackage(tmp_path):
    """Both llm folders gone, the pipeline's file still there: the other queries stay."""
    for name in ("corvane", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.isdir(f"{ROOT}/{name}"):
            shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = set(e.queries()); assert len(q) > 50 and q == set(e.oracle_sql()) and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
