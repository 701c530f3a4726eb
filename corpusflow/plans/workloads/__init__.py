"""The queries of the check and the bench: each reads the given tables in full and names its SQL twin."""

from __future__ import annotations

from importlib import import_module

from corpusflow.plans.workloads.base import ORACLES, QUERIES

for _module in ("retrieval", "web", "chunks", "refresh", "routing", "history", "evaluation", "catalog", "tables", "streams"):
    import_module(f"corpusflow.plans.workloads.{_module}")

__all__ = ["ORACLES", "QUERIES"]
