"""Joins whose sides grow with the table aren't broadcast for an estimate that takes them for small."""

import pytest

from quirel.plans import catalog


def first_plans(spark, after):
    """The plans of later executions as they were before anything was measured."""
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    for i in range(ran.size()):
        if ran.apply(i).executionId() > after:
            yield ran.apply(i).physicalPlanDescription().rpartition("== Initial Plan ==")[2].split("\n\n")[0]


def last_execution(spark):
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((ran.apply(i).executionId() for i in range(ran.size())), default=-1)


@pytest.mark.parametrize("name", "accented_lines mixed_codes tracked_lines typed_notes turned_text spliced_scenes partly_tagged replaced_text written_notes".split())
def test_no_side_is_broadcast_by_its_estimate(spark, sf_dir, name):
    before = last_execution(spark)
    catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    plans = list(first_plans(spark, before))
    assert sum("Join" in p for p in plans) > 3 and not any("BroadcastExchange" in p for p in plans)
