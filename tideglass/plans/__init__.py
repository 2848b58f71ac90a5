"""Queries over the test tables, each with equivalent SQL."""

from . import checks_q, evaluation_q, events_q, joins_q, measures_q, panels_q, portfolio_q, records_q, statistics_q, transforms_q, windows_q
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "regime_months"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "checks_q", "evaluation_q", "events_q", "joins_q", "measures_q", "panels_q", "portfolio_q", "records_q", "statistics_q", "transforms_q", "windows_q"]
