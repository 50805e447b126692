"""Intermediate results and their removal."""

from pathlib import Path

from linkweave import session
from linkweave.session import cut_lineage, remove_intermediates


def test_intermediates_are_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])  # other tests still read theirs
    df = cut_lineage(spark.range(10).toDF("n"), "kept")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 10 and folder.exists()
    assert remove_intermediates(spark) == 1 and not folder.exists()
