"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from . import queries_data, queries_docs, queries_extra, queries_files, queries_imports, queries_more, queries_state  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
