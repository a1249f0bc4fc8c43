"""Small settings tables from YAML: events, response functions, counterfactuals, item semantics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read_yaml(text: str) -> Any:
    """Parsed YAML; refuses keys that YAML 1.1 reads as booleans (an item named NO, say), which must be quoted."""
    import yaml

    data = yaml.safe_load(text)

    def look(node: Any, where: str) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                if isinstance(k, bool):
                    raise ValueError(f"{where}: a key reads as {k}; quote it")
                look(v, f"{where}.{k}")
        elif isinstance(node, list):
            for i, v in enumerate(node):
                look(v, f"{where}[{i}]")

    look(data, "$")
    return data


def table(spark: SparkSession, rows: list[dict], schema: str, required: tuple[str, ...] = (), unique: tuple[str, ...] = ()) -> DataFrame:
    """Rows of settings as a DataFrame; required fields must be there, unique ones must not repeat, unknown ones are refused."""
    names = [c.split()[0] for c in schema.split(",")]
    seen = set()
    for i, row in enumerate(rows):
        if extra := set(row) - set(names):
            raise ValueError(f"row {i}: unknown fields {sorted(extra)}")
        if lacking := [c for c in required if row.get(c) is None]:
            raise ValueError(f"row {i}: {lacking} missing")
        key = tuple(row.get(c) for c in unique)
        if unique and key in seen:
            raise ValueError(f"row {i}: {key} again")
        seen.add(key)
    return spark.createDataFrame([tuple(row.get(c) for c in names) for row in rows], schema)


def events(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Events (name, start, end, status, source); a verified event names its source, and none ends before it starts."""
    for r in rows:
        if r.get("status") == "verified" and not r.get("source"):
            raise ValueError(f"{r.get('name')}: verified without a source")
        if r.get("start") and r.get("end") and r["end"] < r["start"]:
            raise ValueError(f"{r.get('name')}: ends before it starts")
    return table(spark, rows, "name string, start date, end date, status string, source string", required=("name", "start", "end"), unique=("name",))
