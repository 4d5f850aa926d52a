"""The register of named queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.sources import views

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
V = {k: f"{k} AS ({v})" for k, v in views.SQL.items()}


def query(sql: str | None = None, *uses: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``uses`` names the views that its SQL begins with."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            parts = [V[u] for u in uses]
            recursive = "RECURSIVE " if "WITH RECURSIVE" in sql else ""
            body = sql.strip()
            if recursive:
                body = body.replace("WITH RECURSIVE", "WITH", 1)
            if parts and body.startswith("WITH "):
                body = ", ".join(parts) + ", " + body[5:]
            elif parts:
                body = ", ".join(parts) + " " + body
            else:
                body = body.removeprefix("WITH ")
            needs = parts or sql.strip().startswith("WITH")
            _sql[f.__name__] = f"WITH {recursive}{body}" if needs else body
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
