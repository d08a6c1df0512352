"""All queries on the ledger datasets, with their SQL."""

from __future__ import annotations

from quillstream.plans import io_queries, more_queries, report_queries, source_queries, state_queries, sync_queries, voucher_queries

_PARTS = [voucher_queries, report_queries, source_queries, state_queries, io_queries, more_queries, sync_queries, source_queries]


def queries():
    return {k: f for p in _PARTS for k, f in p.queries().items()}


def oracle_sql():
    return {k: s for p in _PARTS for k, s in p.oracle_sql().items()}
