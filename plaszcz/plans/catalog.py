"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import forms, identifiers, workflows

QUERIES: dict = {**identifiers.QUERIES, **forms.QUERIES, **workflows.QUERIES}
ORACLES: dict[str, str] = {**identifiers.ORACLES, **forms.ORACLES, **workflows.ORACLES}
