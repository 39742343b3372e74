"""Every query of the core library by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from spanforge.plans import checks_boxes, checks_flow, checks_jobs, checks_scale, checks_spans, checks_text

QUERIES: dict = checks_text.QUERIES | checks_spans.QUERIES | checks_boxes.QUERIES | checks_jobs.QUERIES | checks_flow.QUERIES | checks_scale.QUERIES
ORACLE_SQL: dict[str, str] = checks_text.ORACLE_SQL | checks_spans.ORACLE_SQL | checks_boxes.ORACLE_SQL | checks_jobs.ORACLE_SQL | checks_flow.ORACLE_SQL | checks_scale.ORACLE_SQL
