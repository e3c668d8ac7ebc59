"""What page records rest on is looked for once a page."""

import pytest

from merchantry.plans import catalog


@pytest.mark.parametrize(
    ("name", "mark"),
    [("mobile_pages", "detail"), ("mobile_pages", "rate_desc"), ("merged_pages", "detail"), ("merged_pages", "goods-property")],
)
def test_one_search_a_page(spark, sf, name, mark):
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000000")
    try:
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
    assert plan.count(rf"(?<![\w-]){mark}(?![\w-])") == 1
