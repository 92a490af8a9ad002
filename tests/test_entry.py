"""The driver's contract holds without the corpus operators, whichever of their files are left."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_imports_without_the_corpus_operators(tmp_path, with_pipeline):
    shutil.copytree(os.path.join(ROOT, "lumenframe"), tmp_path / "lumenframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (with_pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")))]:
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'rate_image' in q and set(s) <= set(q); print(sum(k.startswith('op') or k == 'pipeline' for k in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.strip() == "0"
