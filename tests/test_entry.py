import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "vec_id", "fused", "best_score", "rank"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    for path in [*(ROOT / "docloom").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path
