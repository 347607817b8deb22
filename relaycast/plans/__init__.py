"""Queries over the driver's tables, by family."""

from . import arrays, catalog, extras, missions, models, records, reports, scoring, streams, summary
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "arrays", "catalog", "extras", "missions", "models", "records", "reports", "scoring", "streams", "summary"]
