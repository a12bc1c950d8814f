"""The library without its training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; names = set(e.queries()); assert 'exact_match_links' in names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names; e.oracle_sql()"


@pytest.mark.parametrize("leave_folder, leave_pipeline", [(False, False), (False, True), (True, False)])
def test_entry_loads_without_the_corpus_part(tmp_path, leave_folder, leave_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "lodeweave" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if leave_folder:  # compiled files may stay behind
        (copy / "lodeweave" / "llm" / "__pycache__").mkdir(parents=True)
    if not leave_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, check=True, timeout=120)
