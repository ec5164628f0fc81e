"""The library without the subpackage for training data, in a process of its own."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_points_import(tmp_path, pipeline):
    shutil.copytree(ROOT / "sparkwarden", tmp_path / "sparkwarden", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), set(s) <= set(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    env = {**os.environ, "PYTHONPATH": ""}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, *rest = done.stdout.split()
    assert int(n) > 90 and rest == ["True", "False", "False"]


def test_nothing_else_imports_it():
    for path in (ROOT / "sparkwarden").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(from|import)\s+\S*\bllm\b", path.read_text()), path
