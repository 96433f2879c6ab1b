"""Every registered reconciliation query against its SQL, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import of_duck, of_spark
from tallyloom.plans import extraction_queries, intake_queries, job_queries, match_queries, registry, report_queries, scalar_queries, source_queries, stream_queries
from tallyloom.plans.views import Views

BUILDS = {}
for module in (match_queries, intake_queries, report_queries, job_queries, scalar_queries, extraction_queries, source_queries, stream_queries):
    BUILDS.update(module.add.builds)
#: Queries whose result cannot be empty are all but these.
MAY_BE_EMPTY = {"erp_rows_reused"}


@pytest.fixture(scope="module")
def views(spark, sf_dir):
    return Views(spark, sf_dir)


@pytest.mark.parametrize("name", sorted(BUILDS))
def test_query(name, views, duck):
    found = of_spark(BUILDS[name](views))
    assert found[1] or name in MAY_BE_EMPTY
    if name in registry.ORACLES:
        assert found == of_duck(duck, registry.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
