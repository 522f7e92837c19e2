"""Every query of the library by name, and the SQL that each must equal."""

from __future__ import annotations

from . import curation, more, relational, rest, sections, strings, texts, works  # noqa: F401  they register their queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
