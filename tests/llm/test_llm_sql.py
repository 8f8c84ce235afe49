from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import difference  # noqa: E402

from sentrylake.llm import queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert not difference(queries.QUERIES[name](spark, SF), queries.oracle_sql()[name], SF)


def test_all_are_registered():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
