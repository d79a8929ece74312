"""The engine's queries by name, and their SQL."""

from . import breadth, curation, evaluation, forms, gatetables, logs, models, records, requests, sources, trials
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "breadth", "curation", "evaluation", "forms", "gatetables", "logs", "models", "records", "requests", "sources", "trials"]
