"""Every registered query beside its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

import __spark_entry__ as entry_module
from docwarden.plans import all_queries

QUERIES, ORACLES = all_queries()
# no SQL can give these: fitted models, nested JSON, an approximation by design; each has a test of its own
UNCHECKED = {"report_json", "ensemble_report_json", "gbt_score", "rf_score", "head_score", "stream_dedup"}


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == UNCHECKED
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["verdict"] for r in rows} == {"benign", "malicious"}
    more = set(entry_module.queries()) - set(QUERIES)
    assert set(entry_module.queries()) >= set(QUERIES) and all(n == "pipeline" or n.startswith("op") for n in more)
    assert set(ORACLES) <= set(entry_module.oracle_sql()) <= set(ORACLES) | more


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    assert compare(spark, name, folder, con) is None
