import pytest

import lodeweave.plans.search  # noqa: F401  registers all queries
from lodeweave.plans.catalogue import ORACLES, QUERIES
from tests.compare import SF, connection, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    got = rows(QUERIES[name](spark, SF).toPandas())
    assert got[1] or name in ("kg_contradictions",)
    if name in ORACLES:
        want = rows(connection().sql(ORACLES[name]).df())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert [x for x in zip(got[1], want[1]) if x[0] != x[1]][:3] == []
