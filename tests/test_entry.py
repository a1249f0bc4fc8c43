"""The entry module works with and without the corpus operators' folders and pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"


def asked(folder) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split("\n")[-2]


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_corpus_operators(tmp_path, pipeline):
    for name in ("aerolith", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and os.path.exists(f"{REPO}/corpus_pipeline.py") else [])):
        source = os.path.join(REPO, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(source) else {}))
    n, corpus, stages = asked(tmp_path).split()
    assert int(n) > 140 and corpus == "False" and stages == "False"
