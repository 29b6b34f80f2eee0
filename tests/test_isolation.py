"""Without the training-data operators everything else still imports and is registered."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_the_rest_works_alone(tmp_path):
    shutil.copytree(REPO / "pagemill", tmp_path / "pagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mastery_7d' in q and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    for with_pipeline in (False, True):
        if with_pipeline and (REPO / "corpus_pipeline.py").exists():
            shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
