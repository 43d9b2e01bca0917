"""The library without its training-text part: everything else imports and lists the same queries."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_the_rest_imports_and_lists_its_queries(tmp_path):
    shutil.copytree(ROOT / "ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries() if n[2:3].isdigit() or n == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 170 and int(out[1]) > 165 and out[2] == "False"


def test_nothing_else_imports_it():
    for path in (ROOT / "ledgerline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)[^\n]*\bllm\b", path.read_text())
