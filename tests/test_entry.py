"""The entry module with and without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), sorted(q for q in e.queries() if q.startswith('op') or q == 'pipeline'))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_entry_loads_without_the_training_data_operators(tmp_path, pipeline):
    import stagecraft.queries.load  # noqa: F401
    from stagecraft.queries.registry import QUERIES

    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "stagecraft", copy / "stagecraft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", copy)
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == f"{len(QUERIES)} []", out.stderr
