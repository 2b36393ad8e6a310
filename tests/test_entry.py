"""The driver's entry points, also with the optional folders taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LOAD = """
import __spark_entry__ as e
from quire import queries as Q
extra = set(e.queries()) - set(Q.queries())
assert set(Q.queries()) <= set(e.queries()) and set(Q.oracle_sql()) <= set(e.oracle_sql()) <= set(e.queries())
assert not extra, extra
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_core_works_without_the_llm_folders(tmp_path, pipeline):
    away = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "spark-warehouse", "*.md", "*.json", *([] if pipeline else ["corpus_pipeline.py"]))
    home = tmp_path / "repo"
    shutil.copytree(REPO, home, ignore=away)
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=home, capture_output=True, text=True, timeout=300)
    loaded = run("-c", LOAD)
    assert loaded.returncode == 0, loaded.stderr
    tests = run("-m", "pytest", "--collect-only", "-q", "tests")
    assert tests.returncode == 0, tests.stdout + tests.stderr


def test_every_query_takes_a_session_and_a_folder():
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and all(map(callable, e.queries().values()))
