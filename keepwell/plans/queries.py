"""Every registered query of the retention jobs and its SQL twin."""

from __future__ import annotations

from keepwell.plans import jobs, sql

QUERIES = {name: jobs.as_query(f) for name, f in jobs.JOBS.items()}
ORACLE_SQL = dict(sql.SQL)
