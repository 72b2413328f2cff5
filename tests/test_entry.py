"""The entry with and without what the corpus operators need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(without: str) -> tuple[set[str], str]:
    """Names of the queries, and what was said, in a Python that lacks a module."""
    code = f"import sys; sys.modules[{without!r}] = None; import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return set(said.stdout.split()), said.stderr


@pytest.mark.parametrize("without", ["tokenizers", "xxhash", "zstandard", "public_tokenizers", "corpus_pipeline", "millrace.llm"])
def test_entry_without_optional_parts(without):
    found, said = names(without)
    assert "q_model_quality" in found and not [n for n in found if not n.startswith("q_")] and "without the corpus operators" in said


def test_a_broken_part_is_an_error():
    code = "import sys; sys.modules['pyarrow.compute'] = None; sys.modules['millrace.operators.score'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode != 0
