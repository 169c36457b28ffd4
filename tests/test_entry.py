"""The registered queries: names, SQL, and that the core stands without the text subpackage."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}" for n in range(1, 7)} <= {q.split("_")[0] for q in entry.queries()}


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_text_subpackage():
    for path in (ROOT / "rootstock").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(n.startswith("rootstock.llm") for n in names), path
