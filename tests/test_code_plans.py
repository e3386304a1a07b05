"""What the plans of the file measures must not hold: folds and token patterns over columns, files measured twice."""

import pytest

from siltstone.plans.catalog import CATALOG

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    return CATALOG[name][0](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, passes", [("complexity_histogram", 1), ("baseline_metrics", 2), ("maintainability_index", 3), ("effort_drivers", 2)])
def test_files_are_measured_in_one_pass_each(spark, name, passes):
    found = plan(spark, name)
    assert found.count("MapInArrow") == passes
    assert "aggregate(" not in found and "regexp_extract_all" not in found


def test_effort_bands_measure_files_once(spark):
    assert plan(spark, "effort_bands").count("MapInArrow") == 0  # the signals are one written row
