"""Every registered query against its SQL, and again with hot keys split."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from fleetlens.plans.registry import BUILDS, ORACLES, QUERIES
from fleetlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"

# queries whose operator cuts large groups; here a group is large from 25 rows on
SPLIT = """
a1_running_counters a4_latency a10_incidents a11_mttr a12_mtbf a15_sessions a23_worker_stats a31_dr_compliance
j1_nest j4_nest_skip_level j10_correlate j11_change_events u6_build_report w1_counter_rate w6_islands
w5_alert_intervals w5_alert_states w7_probe_state w12_assign_ids w13_positions
""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_split_groups(spark, con, name):
    assert difference(BUILDS[name](Tables(spark, SF, rows_per_task=25)), con, ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["request_id", "organization_id", "error", "outcome", "lock_key", "envelope"]
    assert {r[0] for r in df.select("outcome").distinct().collect()} >= {"accepted", "throttled", "invalid"}
