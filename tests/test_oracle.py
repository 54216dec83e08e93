"""A spread of registered queries against their SQL twins at the smallest scale.

``tests/compare.py`` runs all of them.
"""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["adp_timestamps", "adp_event_types", "adp_standardize", "ses_gap", "ses_given", "ses_numbers", "ses_dedup_timestamps", "fea_vector", "beh_asof",
         "beh_effective", "beh_drift", "beh_window_deviations", "beh_novelty", "rsk_rule", "rsk_fused", "seq_padded", "spl_stratified", "sco_masked_huber",
         "thr_compare", "met_ovr_auc", "met_class_report", "exp_contributors", "inc_build", "cor_campaigns", "dq_event_shape", "dim_employee", "str_sessions"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 74
