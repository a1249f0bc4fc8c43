"""Named queries over the given tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict, dict]:
    from aerolith.catalog import aggregates, audits, designs, joins, panels, quality, sensors, spatial, statistics, streams  # noqa: F401

    return QUERIES, ORACLE_SQL
