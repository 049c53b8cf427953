"""All queries of the library but for those of the optional subpackage."""

from resonant.plans import ledger_queries, output_queries, probe_queries, report_queries, series_queries, spectral_queries, stream_queries  # noqa: F401
from resonant.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
