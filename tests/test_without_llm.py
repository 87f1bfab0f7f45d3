"""The library and its entry work where the training-data subpackage is absent."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "sitewright", tmp_path / "sitewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bulk_sites' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_it():
    for path in (ROOT / "sitewright").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sitewright.llm" not in path.read_text(), path
