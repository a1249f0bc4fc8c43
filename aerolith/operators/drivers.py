"""What drives a tree model: exact shares of each feature in each prediction, by the trees' paths.

A leaf's value counts for a row to the extent that the row goes down its path. With a set of
features known, an unknown feature's splits on the path pass the share of the training rows that
took them. The Shapley share of a feature is then a sum over subsets of the path's features only,
whose products form a polynomial that is multiplied up feature by feature, for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.scores import metrics

#: A leaf: its value, and for each feature on its path (feature, low, high, share): rows with low < x <= high follow the path.
Leaf = tuple[float, list[tuple[int, float, float, float]]]


def leaves(tree) -> tuple[list[Leaf], float]:
    """A Spark regression tree's leaves and its mean over the training rows; continuous features only."""
    found: list[Leaf] = []

    def walk(node, path: dict[int, tuple[float, float, float]]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            found.append((float(node.prediction()), [(f, *bounds) for f, bounds in sorted(path.items())]))
            return
        split, count = node.split(), float(node.impurityStats().count())
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("trees with categorical splits have no thresholds")
        f, at = int(split.featureIndex()), float(split.threshold())
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
            walk(child, path | {f: (*bounds, share * float(child.impurityStats().count()) / count)})

    walk(tree._java_obj.rootNode(), {})
    return found, sum(value * float(np.prod([s for *_, s in path])) for value, path in found)


def tree_shares(tree_leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """rows x features: each feature's share in one tree's predictions, less the tree's mean."""
    out = np.zeros(x.shape)
    for value, path in tree_leaves:
        k = len(path)
        if not k:
            continue
        follows = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path]).astype(float)
        passed = [share for *_, share in path]
        weights = [factorial(m) * factorial(k - 1 - m) / factorial(k) for m in range(k)]
        for i, (f, *_, share) in enumerate(path):
            # coefficients by the number of known features: the product of (share + follows t) over the others
            terms = np.zeros((k, len(x)))
            terms[0] = 1.0
            for j in range(k):
                if j != i:
                    up = terms[:-1] * follows[j]
                    terms *= passed[j]
                    terms[1:] += up
            out[:, f] += value * (follows[i] - share) * (weights @ terms)
    return out


def ensemble(model) -> tuple[list[tuple[float, list[Leaf]]], float]:
    """(weight, leaves) of each tree of a GBT, forest or tree model of Spark ML, and the ensemble's mean."""
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if "RandomForest" in type(model).__name__:
        weights = [1.0 / len(trees)] * len(trees)
    told = [leaves(t) for t in trees]
    return [(w, found) for w, (found, _) in zip(weights, told)], sum(w * mean for w, (_, mean) in zip(weights, told))


def shares(df: DataFrame, model, features: list[str]) -> DataFrame:
    """df with base (the model's mean) and share_<feature> of each feature; base and shares add up to the prediction. Rows with nulls have none."""
    trees, base = ensemble(model)
    rows = df.withColumn("__at", F.array(*(F.col(f).cast("double") for f in features)))
    columns = [f"share_{f}" for f in features]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b.pop("__at").tolist(), dtype=float).reshape(len(b), len(features))
            known = np.isfinite(x).all(axis=1)
            total = np.full(x.shape, np.nan)
            total[known] = sum((w * tree_shares(found, x[known]) for w, found in trees), np.zeros((int(known.sum()), len(features))))
            yield b.assign(base=np.where(known, base, np.nan), **{c: total[:, i] for i, c in enumerate(columns)})

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInPandas(run, f"{head}, base double, {', '.join(f'`{c}` double' for c in columns)}")


def mean_shares(with_shares: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """by, feature, mean_abs_share, share_of_all: how much each feature moves predictions, and its part of all movement."""
    means = with_shares.groupBy(*(by or [])).agg(*(F.avg(F.abs(F.nanvl(F.col(f"share_{f}"), F.lit(None).cast("double")))).alias(f"share_{f}") for f in features))
    total = sum((F.col(f"share_{f}") for f in features), F.lit(0.0))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"share_{f}").alias("mean_abs_share"), F.try_divide(F.col(f"share_{f}"), total).alias("share_of_all")) for f in features)))
    return means.select(*(by or []), rows.alias("r")).select(*(by or []), "r.*")


def feature_sets(df: DataFrame, sets: dict[str, list[str]], label: str, fold: str, role: str, exceeds: float, seed: int = 7, **params) -> tuple[DataFrame, DataFrame]:
    """(scores, shares): for each named feature set and fold a boosted model of the train rows, its metrics and its mean shares over the test rows.

    Sets and folds are few, and each is a training job of its own; rows with nulls in a set's
    features or the label don't take part in that set.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    scores = moved = None
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    for name, features in sets.items():
        rows = VectorAssembler(inputCols=features, outputCol="__x").transform(df.dropna(subset=[*features, label]))
        for k in folds:
            mine = rows.where(F.col(fold) == k)
            model = GBTRegressor(featuresCol="__x", labelCol=label, predictionCol="__p", seed=seed, **({"maxIter": 20, "maxDepth": 4} | params)).fit(mine.where(F.col(role) == "train"))
            tag = [F.lit(name).alias("feature_set"), F.lit(k).alias(fold)]
            test = mine.where(F.col(role) == "test")
            one = metrics(model.transform(test).select(*tag, label, "__p"), ["feature_set", fold], label, "__p", exceeds)
            two = mean_shares(shares(test.select(*features), model, features), features).select(*tag, "*")
            scores, moved = (one, two) if scores is None else (scores.unionByName(one), moved.unionByName(two))
    return scores, moved
