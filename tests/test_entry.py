"""The entry points without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'))"


def test_queries_without_the_subpackage(tmp_path):
    """A leftover cache folder, which is an empty namespace package, is no subpackage."""
    shutil.copytree(ROOT / "statefold", tmp_path / "statefold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "statefold" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split(maxsplit=2)
    assert int(said[0]) > 90 and int(said[0]) == int(said[1]) and said[2].strip() == "[]"
