"""The rest of the repository works without the training-data subpackage, its tests and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("gone", [("playmill/llm", "tests/llm", "corpus_pipeline.py"), ("playmill/llm", "tests/llm"), ("corpus_pipeline.py",), ()])
def test_what_an_installation_may_lack(tmp_path, gone):
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(' '.join(e.queries())); print(len(e.oracle_sql())); print(e.__file__)"
    # a PYTHONPATH that names the repository would let the copy find there what it lacks
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert Path(done.stdout.splitlines()[2]).parent == copy
    names = done.stdout.splitlines()[0].split()
    assert "a07_run_summary" in names
    has_llm, has_pipeline = (copy / "playmill/llm").exists(), (copy / "corpus_pipeline.py").exists()
    assert any(n.startswith("op1_") for n in names) == has_llm
    assert ("pipeline" in names) == (has_llm and has_pipeline)
