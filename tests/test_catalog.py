"""Catalog queries against their SQL at the smallest scale (all of them with SESSIONLOOM_ALL=1)."""

import os

import pytest
from helpers import connect, differences

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "win01_sessionize_6h", "agg02_session_temporal_features", "dom02_bot_score", "dom04_event_features", "dom05_label_events",
    "dom01_motion_features", "dom14_largest_remainder", "dom15_segment_traces", "sch02_default_chain",
    "joi04_rank_matched_join", "win09_decile_strata", "win10_average_rank_pct", "seq01_mouse_steps", "seq04_zero_padded",
    "seq10_remapped_legacy_steps", "smp01_stratified_sample", "smp02_downsample_majority", "aug03_noise_expand", "imp01_impute",
    "cln04_robust_scale", "ano03_iqr_outliers", "agg14_grouped_describe", "agg20_correlation_matrix", "qlt02_inspect_clicks",
    "viz02_box_stats", "evl04_roc_auc", "evl05_micro_roc_curve", "str01_session_windows", "str03_session_interval_features",
    "src03_capped_class_scan", "src05_read_head", "rnd03_correlated_normals", "viz01_density_curve", "viz01_density_surface", "agg20_blocked_moments",
    "str02_labelled_sessions", "str06_late_rows", "mdl03_jobs_equal_task",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def names():
    return sorted(driver.queries()) if os.environ.get("SESSIONLOOM_ALL") else QUICK


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    df = driver.queries()[name](spark, FOLDER)
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, sql) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
