"""The rest stands without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_the_corpus_operators(tmp_path, pipeline):
    shutil.copytree(REPO / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and (REPO / "corpus_pipeline.py").exists())]:
        shutil.copy(REPO / name, tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q); assert not [n for n in q if n.startswith('op')] and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
