"""All core queries and their SQL; importing the query modules registers them."""

from __future__ import annotations

from . import q_audit, q_contacts, q_entities, q_export, q_leads, q_queue, q_runs, q_scalars, q_sources, q_streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
