"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/lexgrid", tmp_path / "lexgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 40 and not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/lexgrid"):
        if not folder.startswith(f"{ROOT}/lexgrid/llm"):
            for n in names:
                if n.endswith(".py"):
                    with open(f"{folder}/{n}", encoding="utf-8") as f:
                        assert "lexgrid.llm" not in f.read()
