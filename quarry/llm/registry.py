"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in ("warc", "sharding", "quality_rules", "masked_lm", "weak_quality", "language_id", "html_text", "pieces", "minhash", "decontaminate", "licenses", "alignment", "conversation_repair"):
    _m = import_module(f"quarry.llm.{_module}")
    for _name, _f in vars(_m).items():
        if _name.startswith("op") and callable(_f):
            QUERIES[_name] = _f
            if hasattr(_m, "SQL"):
                ORACLE_SQL[_name] = _m.SQL
