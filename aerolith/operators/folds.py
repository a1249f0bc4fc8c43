"""Weighted ridge regressions of all held-out designs from one aggregate of fold cells.

A row lies in one cell, a station fold and a quarter. A design's fold trains on whole cells: all
but the held station fold, all but the held quarter, or (joint) neither of both. So the cells'
weighted sums, a few dozen rows, hold all that every fit needs; a fold's training sums are those of its cells, and
no row is read once more for each fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.audits import held_out_design
from aerolith.operators.scores import metrics

FOLD = ["design", "held_station_fold", "held_quarter"]
_FOLD_TYPES = "design string, held_station_fold int, held_quarter int"


def _cells(rows: DataFrame, xs: list[str]) -> tuple[DataFrame, list[float]]:
    """Sums of each cell (__s, __q), of values less their overall means (which go to the caller), so that no digits are lost in differences."""
    names = ["__y", *xs]
    centre = [float(v or 0.0) for v in rows.agg(*(F.avg(c) for c in names)).first()]
    w, v = F.col("__w"), [F.col(c) - m for c, m in zip(names, centre)]
    sums = [F.sum(w * a).alias(f"s{i}") for i, a in enumerate(v)] + [F.sum(w * v[i] * v[j]).alias(f"p{i}_{j}") for i in range(len(v)) for j in range(i, len(v))]
    return rows.groupBy("__s", "__q").agg(F.count(F.lit(1)).alias("rows"), F.sum(w).alias("w"), F.min("__y").alias("low"), F.max("__y").alias("high"), *sums), centre


def fold_states(cells: DataFrame, station_folds: int) -> DataFrame:
    """Every fold of the three designs with its training sums and its state: scored, or the first of the reasons why not."""
    marked = held_out_design(cells, "__s", "__q", station_folds)
    train, test = F.col("role") == "train", F.col("role") == "test"
    sums = [c for c in cells.columns if c not in ("__s", "__q", "rows", "low", "high")]
    of = lambda f, c, side: f(F.when(side, F.col(c)))
    out = marked.groupBy(*FOLD).agg(
        *(F.coalesce(of(F.sum, "rows", side), F.lit(0)).alias(f"{n}_rows") for side, n in ((train, "train"), (test, "test"))),
        *((of(F.min, "low", side) < of(F.max, "high", side)).alias(f"{n}_varies") for side, n in ((train, "train"), (test, "test"))),
        *(of(F.sum, c, train).alias(c) for c in sums),
    )
    rules = [
        (F.col("train_rows") == 0, "unscored_empty_train"),
        ((F.col("train_rows") < 2) | ~F.col("train_varies"), "unscored_insufficient_train"),
        (F.col("test_rows") == 0, "unscored_empty_test"),
        (~F.col("test_varies"), "unscored_single_target"),
    ]
    state = F.lit("scored")
    for condition, name in reversed(rules):
        state = F.when(condition, name).otherwise(state)
    return out.withColumn("state", state)


def ridge_folds(rows: DataFrame, station_fold: str, quarter: str, y: str, models: dict[str, list[str]], weight: str, station_folds: int, alpha: float = 1.0, raw: str | None = None, exceeds: float = float("inf")) -> DataFrame:
    """design, held_station_fold, held_quarter, state, train_rows, test_rows, model, rmse, mae, r2: each model's scores on every fold's test rows.

    models: features of each ridge regression, scaled to weighted mean 0 and deviation 1 of the
    fold's own training rows. raw: a column that predicts as it is (model `raw`). Rows with nulls
    take no part. Folds that can't be scored stay, with their state and null scores; folds whose cells are all absent
    don't exist.
    """
    xs = list(dict.fromkeys(x for features in models.values() for x in features))
    own = {"__s": F.col(station_fold).cast("int"), "__q": F.col(quarter).cast("int"), "__y": F.col(y).cast("double"), "__w": F.col(weight).cast("double")}
    own |= {f"__x{i}": F.col(x).cast("double") for i, x in enumerate(xs)} | ({"__raw": F.col(raw).cast("double")} if raw else {})
    rows = rows.select(*(c.alias(n) for n, c in own.items())).dropna()
    cells, centre = _cells(rows, [f"__x{i}" for i in range(len(xs))])
    states = fold_states(cells, station_folds)
    place = {x: i + 1 for i, x in enumerate(xs)}

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                mean = lambda i: r[f"s{i}"] / r["w"]  # noqa: B023, E731
                cross = lambda i, j: r[f"p{min(i, j)}_{max(i, j)}"] - r["w"] * mean(i) * mean(j)  # noqa: B023, E731
                head = tuple(None if pd.isna(r[c]) else r[c] for c in FOLD)
                for model, features in models.items():
                    at = [place[x] for x in features]
                    sd = np.array([np.sqrt(max(cross(i, i), 0.0) / r["w"]) or 1.0 for i in at])
                    gram = np.array([[cross(i, j) for j in at] for i in at]) / np.outer(sd, sd)
                    beta = np.linalg.solve(gram + alpha * np.eye(len(at)), np.array([cross(i, 0) for i in at]) / sd) / sd
                    full = np.zeros(len(xs))
                    full[[i - 1 for i in at]] = beta
                    level = mean(0) + centre[0] - sum(k * (mean(i) + centre[i]) for i, k in zip(at, beta))
                    out.append((*head, model, float(level), full.tolist()))
            yield pd.DataFrame(out, columns=[*FOLD, "model", "level", "beta"]).astype({"held_station_fold": "Int32", "held_quarter": "Int32"})

    fits = states.where("state = 'scored'").mapInPandas(fit, f"{_FOLD_TYPES}, model string, level double, beta array<double>")
    s, q = F.col("__s"), F.col("__q")
    none = F.lit(None).cast("int")
    three = F.array(*(F.struct(F.lit(d).alias("design"), a.alias("held_station_fold"), b.alias("held_quarter")) for d, a, b in (("station", s, none), ("quarter", none, q), ("joint", s, q))))
    tested = rows.withColumn("__f", F.explode(three))
    same = F.lit(True)
    for c in FOLD:
        same = same & F.col(f"__f.{c}").eqNullSafe(F.col(f"m.{c}"))
    # the fits are as many as folds and models, whatever the rows
    met = tested.join(F.broadcast(fits.alias("m")), same)
    line = F.col("m.level") + sum((F.col("m.beta")[i] * F.col(f"__x{i}") for i in range(len(xs))), F.lit(0.0))
    said = met.select(*(F.col(f"m.{c}").alias(c) for c in (*FOLD, "model")), "__y", line.alias("__p"))
    if raw:
        scored = F.broadcast(states.where("state = 'scored'").select(*FOLD).alias("m"))
        said = said.unionByName(tested.join(scored, same).select(*(F.col(f"m.{c}").alias(c) for c in FOLD), F.lit("raw").alias("model"), "__y", F.col("__raw").alias("__p")))
    found = metrics(said, [*FOLD, "model"], "__y", "__p", exceeds).drop("n", "f1")
    names = F.explode(F.array(*map(F.lit, [*models, *(["raw"] if raw else [])])))
    every = states.select(*FOLD, "state", "train_rows", "test_rows", names.alias("model"))
    on = F.col("a.model") == F.col("b.model")
    for c in FOLD:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return every.alias("a").join(found.alias("b"), on, "left").select("a.*", "b.rmse", "b.mae", "b.r2")
