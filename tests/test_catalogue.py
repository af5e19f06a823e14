import pytest

from corvane.plans.catalogue import ORACLES, QUERIES
from tests.compare import duck, rows_by_sql, rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    columns, want = rows_by_sql(duck(SF), ORACLES[name])
    assert sorted(frame.columns) == columns
    got = rows_of(frame)
    assert got == want and got
