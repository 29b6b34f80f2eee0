"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import oracle  # noqa: E402

from pagemill.plans import catalogue  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, name):
    assert "DIFFERENT" not in oracle.differences(spark, name, sf_dir)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["user_id", "day", "minutes", "goal_met"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
