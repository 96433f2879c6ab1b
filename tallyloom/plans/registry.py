"""Names of the registered queries and of the SQL they are held against."""

from __future__ import annotations

from tallyloom.plans import extraction_queries, intake_queries, job_queries, match_queries, report_queries, scalar_queries, source_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (match_queries, intake_queries, report_queries, job_queries, scalar_queries, source_queries, stream_queries, extraction_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
