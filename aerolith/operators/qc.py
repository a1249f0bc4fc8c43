"""Quality rules: they flag or withhold, and never repair. Values out of range keep their number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.flags import NO_RAIN, OUT_OF_RANGE, VALID, mapping


def sentinels(df: DataFrame, measure: str, value: str, flag: str, marks: dict[str, dict[float, str]]) -> DataFrame:
    """Valid readings that equal a measure's sentinel lose their value and get the sentinel's flag."""
    hit = F.lit(None).cast("string")
    for name, values in marks.items():
        for number, says in values.items():
            hit = F.when((F.col(measure) == name) & (F.col(flag) == VALID) & (F.col(value) == float(number)), F.lit(says)).otherwise(hit)
    marked = df.withColumn("__hit", hit)
    return marked.withColumn(value, F.when(F.col("__hit").isNull(), F.col(value))).withColumn(flag, F.coalesce("__hit", flag)).drop("__hit")


def no_rain_is_zero(df: DataFrame, measure: str, value: str, flag: str, measures: list[str]) -> DataFrame:
    """"No rain" of a rain measure is 0.0; the flag stays."""
    dry = F.col(measure).isin(*measures) & (F.col(flag) == NO_RAIN) & F.col(value).isNull()
    return df.withColumn(value, F.when(dry, F.lit(0.0)).otherwise(F.col(value)))


def ranges(df: DataFrame, measure: str, value: str, flag: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Valid readings outside their measure's bounds are flagged and keep their value; measures without bounds pass."""
    low = F.try_element_at(mapping({k: float(v[0]) for k, v in bounds.items()}), F.col(measure))
    high = F.try_element_at(mapping({k: float(v[1]) for k, v in bounds.items()}), F.col(measure))
    out = (F.col(flag) == VALID) & ((F.col(value) < low) | (F.col(value) > high))
    return df.withColumn(flag, F.when(F.coalesce(out, F.lit(False)), F.lit(OUT_OF_RANGE)).otherwise(F.col(flag)))


def consistency(wide: DataFrame, by: list[str], rules: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """Per group and rule: rows where all of the rule's columns are known, violations and their rate.

    rules: name -> (columns, condition that holds when all is well). Rules over absent columns are skipped.
    """
    aggs = []
    live = {k: v for k, v in rules.items() if set(v[0]) <= set(wide.columns)}
    for name, (columns, holds) in live.items():
        known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
        aggs += [F.count_if(known).alias(f"{name}__checked"), F.count_if(known & ~holds).alias(f"{name}__violations")]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"{k}__checked").alias("checked"), F.col(f"{k}__violations").alias("violations")) for k in live)))
    return wide.groupBy(*by).agg(*aggs).select(*by, rows.alias("r")).select(*by, "r.*").withColumn("rate", F.round(F.try_divide(F.col("violations"), F.col("checked")), 6))


def duplicate_conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows disagree; a null counts as a value."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*values)).alias("versions")).where("versions > 1")


def collapse_duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def cascade(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The reason of the first rule that holds."""
    out = F.lit(otherwise)
    for holds, reason in reversed(rules):
        out = F.when(holds, F.lit(reason)).otherwise(out)
    return out


def majority_label(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Per key the commonest non-null label, ties to the smaller, its rows, and whether others occur."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("members"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("ambiguous", F.count(F.lit(1)).over(w) > 1).withColumn("__n", F.row_number().over(w.orderBy(F.desc("members"), F.asc(label))))
    return ranked.where("__n = 1").drop("__n")


def validation(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row: rows, duplicate keys, and how many rows break each rule. Two small aggregates, no row leaves the cluster."""
    broken = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    twice = df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))
    return broken.crossJoin(twice)


def require(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """df, failing when read at a row for which `holds` isn't true."""
    return df.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
