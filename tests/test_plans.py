"""Scale checks on the physical plans of every registered query."""

import uuid

import pytest

from cachescope.plans.queries import REGISTRY

from .conftest import SF_SMALL

NAMES = sorted(REGISTRY)


def _plan(spark, name):
    df = REGISTRY[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", NAMES)
def test_unpartitioned_windows_only_over_segment_summaries(spark, name):
    """A window without partition keys pulls its input into one task; the only
    one allowed orders the per-segment summary (one row per time segment)."""
    for line in _plan(spark, name).splitlines():
        if "windowspecdefinition(" not in line:
            continue
        for spec in line.split("windowspecdefinition(")[1:]:
            first = spec.split(",")[0]
            if " ASC " in first + " " or " DESC " in first + " ":
                assert first.startswith("_seg#"), (name, first)


def test_feed_is_top_k(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "event_feed")


def test_timeline_filter_reaches_scan(spark):
    df = REGISTRY["timeline"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: [" in plan and "ts#" in plan.split("DataFilters: [", 1)[1].split("]")[0]


@pytest.mark.parametrize("name", ["pii_redact", "pii_entities", "pii_events", "pii_counts"])
def test_redaction_cascade_evaluated_once(spark, name):
    """One regexp_replace per pattern in the whole plan: no copy of the cascade
    pushed below the exchange by a filter or duplicated by projection collapse."""
    plan = _plan(spark, name)
    assert plan.count("<EMAIL_ADDRESS>, 1)") == 1, plan[:2000]
    assert plan.count("<PHONE_NUMBER>, 1)") == 1


def test_json_parsed_once(spark):
    assert _plan(spark, "event_decode").count("from_json(") == 1
    assert _plan(spark, "request_parse").count("parseJson") <= 1


def _jobs(spark, make):
    """Jobs that building a frame starts."""
    group = f"building-{uuid.uuid4().hex}"  # of its own: a group's jobs are counted over the whole session
    spark.sparkContext.setJobGroup(group, group, False)
    try:
        make()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["pii_redact", "pii_events", "pii_last_message", "pii_spans", "event_feed", "cache_list",
                                  "request_parse", "traffic_by_minute", "session_load"])
def test_building_a_query_only_reads_footers(spark, name):
    assert _jobs(spark, lambda: REGISTRY[name](spark, SF_SMALL)) <= 2  # one per table read
