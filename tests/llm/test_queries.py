"""The queries of this package against their SQL twins, with names and types of columns."""

import pytest
from compare import connection, differences

from tallyframe.llm.queries import ORACLES, QUERIES
from tallyframe.session import owned


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, name, folder):
    with owned(spark):
        assert differences(QUERIES[name](spark, folder), connection(folder), ORACLES[name]) == []


def test_names():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
