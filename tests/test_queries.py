"""Every registered query with comparison SQL must agree with it."""

import pytest
from compare import difference

from innings.plans.registry import entries

EXACT = [n for n, e in entries().items() if e.oracle]


@pytest.mark.parametrize("name", EXACT)
def test_agrees_with_sql(name, spark, duck, sf):
    message, _ = difference(spark, duck, entries()[name], sf)
    assert message == ""


def test_entry_points(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
