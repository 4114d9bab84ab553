"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["pool", "series", "items", "characters", "share", "avg_skins"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 50


def test_core_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "cardloom", tmp_path / "cardloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'game_stats' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=120)


def test_core_never_imports_them():
    for path in (ROOT / "cardloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "cardloom.llm" not in path.read_text()


def test_errors_within_the_training_data_operators_are_errors(tmp_path):
    (tmp_path / "cardloom" / "llm").mkdir(parents=True)
    shutil.copytree(ROOT / "cardloom", tmp_path / "cardloom", dirs_exist_ok=True, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "cardloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "cardloom" / "llm" / "entry_queries.py").write_text("import a_module_that_is_not_there\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=120, capture_output=True, text=True)
    assert done.returncode and "a_module_that_is_not_there" in done.stderr
