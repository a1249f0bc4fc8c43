"""Models on Spark ML: boosted trees and forests with folds, weather normalisation, seasonal autoregression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_predict(df: DataFrame, features: list[str], label: str, role: str = "role", kind: str = "gbt", seed: int = 7, **params) -> DataFrame:
    """The test rows with `predicted`, by a model of the train rows (kind: gbt, forest or linear); rows with nulls don't take part."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    makers = {
        "gbt": lambda: GBTRegressor(featuresCol="__x", labelCol=label, predictionCol="predicted", seed=seed, **({"maxIter": 20, "maxDepth": 4} | params)),
        "forest": lambda: RandomForestRegressor(featuresCol="__x", labelCol=label, predictionCol="predicted", seed=seed, **({"numTrees": 30, "maxDepth": 6} | params)),
        "linear": lambda: LinearRegression(featuresCol="__x", labelCol=label, predictionCol="predicted", **params),
    }
    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(df.dropna(subset=[*features, label]))
    model = makers[kind]().fit(rows.where(F.col(role) == "train"))
    return model.transform(rows.where(F.col(role) == "test")).drop("__x")


def normalise_weather(df: DataFrame, ts: str, value: str, weather: list[str], time: list[str], draws: int = 5, seed: int = 3, cell: Column | None = None, kind: str = "forest") -> DataFrame:
    """Monthly means (month, observed, hours: how many, normalised) of values and of a model's predictions under weather of other, randomly met rows.

    Each draw gives every row the weather of a row of its cell (the hour of day, where none is
    named), all its columns together, so joint weather stays possible; a row may be drawn more
    than once. Rows are numbered by cell and time without one task for a cell, kept once, and
    draws are md5 digests of a row's place, so one equi-join by place brings all of them, alike
    on every engine. kind: forest (Spark ML) or linear (least squares). Rows with nulls don't take part.
    """
    from aerolith.functions.maths import draw
    from aerolith.operators.stats import ols
    from aerolith.operators.windows import numbered
    from aerolith.session import cut

    spark = df.sparkSession
    month = F.trunc(ts, "MM")
    rows = df.dropna(subset=[value, *weather, *time]).select(ts, value, *weather, *time, (F.hour(ts) if cell is None else cell).alias("__cell"))
    placed = cut(numbered(rows, ["__cell", ts, *weather, *time], F.struct("__cell", month.alias("m")), "__place"))
    if kind == "linear":
        fit = {r["term"]: r["coef"] for r in ols(placed, value, [*weather, *time]).collect()}
        line = sum((F.lit(c) * F.col(t) for t, c in fit.items() if t != "intercept"), F.lit(fit.get("intercept")))
        predict = lambda met: met.withColumn("__p", line)
    else:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import RandomForestRegressor

        assembler = VectorAssembler(inputCols=[*time, *weather], outputCol="__x")
        model = RandomForestRegressor(featuresCol="__x", labelCol=value, predictionCol="__p", numTrees=20, maxDepth=6, seed=seed).fit(assembler.transform(placed))
        predict = lambda met: model.transform(assembler.transform(met))
    cells = placed.groupBy("__cell").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    asked = placed.select(ts, *time, "__cell", "__place").join(cells, "__cell").withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    asked = asked.select(ts, *time, (F.col("__first") + F.floor(draw(F.col("__place"), F.col("__d"), seed) * F.col("__n"))).alias("__place"))
    met = predict(asked.join(placed.select("__place", *weather), "__place"))
    normal = met.groupBy(month.alias("month")).agg(F.avg("__p").alias("normalised"))
    seen = placed.groupBy(month.alias("month")).agg(F.avg(value).alias("observed"), F.count(F.lit(1)).alias("hours"))
    return seen.join(normal, "month")


def weather_share(months: DataFrame) -> DataFrame:
    """One row from monthly means: slopes a year (median of all pairs of months) of observed and normalised values, and the share of the trend that weather made; null where nothing was observed to change."""
    from aerolith.operators.stats import theil_sen

    x = (F.year("month") + (F.month("month") - 1) / F.lit(12.0)).alias("x")
    long = months.select(x, "observed", "normalised").unpivot(["x"], ["observed", "normalised"], "what", "y").where("y is not null")
    slopes = theil_sen(long, ["what"], "x", "y")
    both = slopes.agg(*(F.max(F.when(F.col("what") == c, F.col("slope"))).alias(f"{c}_slope") for c in ("observed", "normalised")))
    return both.withColumn("weather_share", F.round(F.when(F.col("observed_slope") != 0, (F.col("observed_slope") - F.col("normalised_slope")) / F.col("observed_slope")), 4))


def seasonal_autoregression(df: DataFrame, entity: str, ts: str, value: str, season: int = 24, horizon: int = 1, train_share: float = 0.7) -> DataFrame:
    """Per series: forecasts `horizon` ahead from the last value, the last season's and their difference (least squares on the first part), beside persistence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(ts)
        x = rows[value].astype(float).interpolate(limit_direction="both").to_numpy()
        lead = season + horizon
        cols = ["entity", "ts", "y_true", "predicted", "persistence"]
        if len(x) < 3 * lead:
            return pd.DataFrame(columns=cols)
        at = np.arange(lead, len(x))
        design = np.stack([np.ones(len(at)), x[at - horizon], x[at - season], x[at - horizon - season]], axis=1)
        cut = int(train_share * len(at))
        beta, *_ = np.linalg.lstsq(design[:cut], x[at[:cut]], rcond=None)
        test = at[cut:]
        out = pd.DataFrame({"entity": rows[entity].iloc[0], "ts": rows[ts].to_numpy()[test], "y_true": rows[value].astype(float).to_numpy()[test], "predicted": design[cut:] @ beta, "persistence": x[test - horizon]})
        return out.dropna(subset=["y_true"])

    return df.groupBy(entity).applyInPandas(run, f"entity {dict(df.dtypes)[entity]}, ts timestamp_ntz, y_true double, predicted double, persistence double")
