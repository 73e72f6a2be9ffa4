"""Rules for the sources of the corpus operators."""

import ast
import re
from pathlib import Path

from cohortlab.llm import catalog

SOURCES = sorted(Path(catalog.__file__).resolve().parent.glob("*.py"))
BANNED = (r"\.crossJoin\(", r"localCheckpoint", r"\.rdd\.(map|flatMap|groupBy)")


def called(node) -> set[str]:
    """Names of the functions and methods called anywhere in ``node``."""
    calls = (n.func for n in ast.walk(node) if isinstance(n, ast.Call))
    return {f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "") for f in calls}


def test_no_forbidden_calls():
    for source in SOURCES:
        for pattern in BANNED:
            assert not re.search(pattern, source.read_text()), (source.name, pattern)


def test_row_numbers_are_written_before_use():
    """Spark's row numbers change with the plan, so the function that gives them writes them at once."""
    for source in SOURCES:
        for function in (n for n in ast.walk(ast.parse(source.read_text())) if isinstance(n, ast.FunctionDef)):
            names = called(function)
            if "monotonically_increasing_id" in names:
                assert names & {"materialize", "parquet"}, (source.name, function.name)
