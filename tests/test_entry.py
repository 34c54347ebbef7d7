import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_registered_queries():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80 and {"p2_found", "p3_found", "deterministic_linkage"} <= set(queries)


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["c_custkey", "s_suppkey", "matchkey"] and got.count() > 0


def test_nothing_outside_uses_the_llm_part():
    for file in (ROOT / "kinweave").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(file.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), file
