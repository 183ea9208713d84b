"""Every query over the driver tables by name, with the DuckDB SQL that gives the same rows."""

from . import aggregates, execution, governance, joins, ledgers, scalars, statistics, texts, windows  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
