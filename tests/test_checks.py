"""Queries against their SQL on the smallest tables. EDITWARDEN_ALL=1 runs all of them."""

import os

import pytest

from checks import all_checks
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_checks()
CORE = (
    "F4_tag_diff", "F9_continents", "F14_source", "F24_mine_reverts", "W3_user_distinct_cum", "W7_user_rate", "A4_score_profile",
    "A7_describe_counts", "J3_missing_ids", "J9_diff_tables", "L2_sample_per_group", "L3_realistic_split", "V3_auc_roc", "V7_best_threshold",
    "V10_regional_report", "V13_bootstrap", "M2_assign_clusters", "E1_continents", "S6_read_changesets_xml", "K3_write_flagged", "G2_score_stream",
    "flagged_share_per_month",
)
NAMES = sorted(SQL) if os.environ.get("EDITWARDEN_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(con, QUERIES[name](spark, SF), SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
