"""Quick registered queries against their SQL on the smallest tables.

`python tests/side_by_side.py <sf_dir>` compares all of them.
"""

import os

import pytest

from folioscope.workload.oracles import oracles
from folioscope.workload.queries import queries
from tests.side_by_side import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUICK = ("s5c_invoices", "s6_last_row_wins", "s10_official_list", "s11_full_catalog",
         "s14_invoice_fields", "s17b_archive_listing", "s21_parsed_drafts", "v1_money_network",
         "v2_invoices_against_bank", "i1_check_character", "i5_nearest_known", "l1_status_lookup",
         "c1_counts_by_status", "t1_percentiles", "m1_folded_text", "d2_unmatched_payments",
         "d4_vague_concepts", "a1_cited_identifiers", "a3_denied_cases", "q1_guarded_sql")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, connection, name):
    same, note = compare(spark, connection, name, queries()[name], oracles()[name], SF_DIR)
    assert same, note


def test_every_query_has_its_sql():
    assert set(queries()) == set(oracles())
