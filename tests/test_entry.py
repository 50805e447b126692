"""The driver contract, and a few registered queries next to their SQL."""

import importlib.util
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("compare_tool", ROOT / "tools" / "compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


def test_every_oracle_has_a_query():
    assert set(compare.entry.oracle_sql()) <= set(compare.entry.queries())
    assert len(compare.entry.queries()) > 100


@pytest.mark.parametrize(
    "name", ["profile_relations", "best_statements", "merged_calls", "claim_paths", "vector_top_k", "exact_duplicates", "streamed_events"]
)
def test_query_matches_sql(spark, folder, name):
    verdict, rows, _, detail = compare.compare(spark, folder, name)
    assert verdict == "same" and rows > 0, detail
