"""All registered queries of the analytics library and their DuckDB SQL."""

from __future__ import annotations

from . import audits, comparisons, inference, labels, models, runs, serving, stores, studies
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "comparisons", "inference", "labels", "models", "runs", "serving", "stores", "studies"]
