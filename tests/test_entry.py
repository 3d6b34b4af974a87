"""The entry points in copies of the repository without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [("slatewise/llm", "tests/llm"), ("slatewise/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__") or str((Path(folder) / n).relative_to(ROOT)) in gone])
    said = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 150 and int(said[1]) > 150 and said[2:] == ["False", "False"]
