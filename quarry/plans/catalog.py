"""All queries of the reference's own operators, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from quarry.plans.registry import ORACLE_SQL, QUERIES

MODULES = ("retrieval", "library", "chats", "texts", "money", "dates", "vectors", "extraction", "metering", "clients", "reorg", "questions", "replies", "analysis", "reports")

for _name in MODULES:
    import_module(f"quarry.plans.{_name}_queries")

__all__ = ["ORACLE_SQL", "QUERIES"]
