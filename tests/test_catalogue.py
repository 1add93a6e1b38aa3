import pytest

from mosaica.plans import catalogue
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    frame = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE:
        assert_same(frame, catalogue.ORACLE[name], SF)
    else:
        assert frame.count() == 16


def test_filters_reach_the_files(spark, sf):
    plan = catalogue.range_int(spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), GreaterThanOrEqual(o_custkey,27), LessThanOrEqual(o_custkey,45)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
