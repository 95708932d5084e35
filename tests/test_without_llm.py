"""The rest stands without the optional subpackage and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "trawl", tmp_path / "trawl", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "trawl").rglob("*.py"):
        if "llm" not in path.parts:
            assert "trawl.llm" not in path.read_text(), path
