"""All registered queries and their DuckDB oracles, by name."""

from __future__ import annotations

from auditspark.plans import adjudicate_queries, code_queries, contract_queries, evaluate_queries, findings_queries, graph_queries, history_queries, ledger_queries, record_queries, report_queries, scan_queries, stream_queries, web_queries  # noqa: F401
from auditspark.plans.base import ORACLES, QUERIES  # noqa: F401
