"""The block half works in a copy without the document operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_stands_alone(tmp_path, also):
    at = tmp_path / "copy"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *also))
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=at, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    assert "latest_mapping" in found.stdout and "op1_" not in found.stdout and "pipeline" not in found.stdout
