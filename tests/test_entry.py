import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs_without_the_training_data_operators(tmp_path):
    """The engine's queries stand by themselves: nothing outside the subpackage needs it."""
    for name in ("__spark_entry__.py", "deltaweave"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "deltaweave" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and 'pipeline' not in q and not any(k[:2] == 'op' and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_modules_import():
    for name in ("zset", "functions.scalar", "operators.batch", "plans.nodes", "plans.engine", "sources.tables", "streaming.late"):
        importlib.import_module(f"deltaweave.{name}")
