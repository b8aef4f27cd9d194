import pytest

from rostrum.plans import registry


@pytest.mark.parametrize("name", ["J10_T7_compare", "T10_diagnosis"])
def test_texts_go_to_python_in_small_batches(spark, sf, name):
    # only what is written at once has batches of few bytes, whatever the caller's session says
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
