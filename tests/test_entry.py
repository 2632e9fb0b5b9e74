"""The registries, and that nothing outside the llm subpackage imports it."""

import pathlib
import subprocess
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_registries_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_registries_are_read_without_a_session():
    code = "import __spark_entry__ as entry; assert len(entry.queries()) > 100 and entry.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert [(r["fold"], r["n"]) for r in sorted(rows)] == [("1999", 108), ("2000", 108), ("2001", 88)]


def test_library_does_not_import_the_llm_subpackage():
    for path in (ROOT / "panelspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "panelspark.llm" not in path.read_text()
