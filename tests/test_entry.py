"""The driver's contract, and that the rest stands without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["day", "items", "records", "last_us"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stands_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "keepsake", tmp_path / "keepsake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "keepsake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
