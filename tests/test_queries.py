"""Queries against their reference SQL. BOXLINE_ALL=1 runs every one of them."""

import os

import pytest

from compare import QUERIES, compare, connect

SF = os.environ.get("BOXLINE_SF", "/root/testdata/sf0.001")
QUICK = (
    "normalise_text", "normalise_dates", "fixture_match_two_stage", "customer_outer_merge", "kpi_summary", "expected_index_ticket_class",
    "segment_projection", "validation_warnings",
)
NAMES = list(QUERIES) if os.environ.get("BOXLINE_ALL") else list(QUICK)


@pytest.fixture(scope="module")
def oracle():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    outcome = compare(spark, oracle, SF, name)
    assert outcome.startswith(("ok", "rows only")), outcome
