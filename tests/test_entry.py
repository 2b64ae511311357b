"""The driver's entry imports with and without the training-data operators."""
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("without", [["lograil/llm", "tests/llm"], ["lograil/llm", "tests/llm", "corpus_pipeline.py"]])
def test_import_without_the_training_data_operators(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt", "*.md"))
    for name in without:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, operators, pipeline = done.stdout.split()
    assert int(count) > 100 and (operators, pipeline) == ("False", "False")
