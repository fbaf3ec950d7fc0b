"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest
from compare import same

from gistmill import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, name):
    same(spark, SF, plans.QUERIES[name], plans.ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
