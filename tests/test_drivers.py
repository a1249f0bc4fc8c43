"""Shares of features against all subsets, and that they add up; tables out of HTML."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import drivers
from aerolith.sources import html

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def fitted(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 5)), 2)
    y = 3 * x[:, 0] + x[:, 1] * x[:, 2] + np.where(x[:, 3] > 0.3, 2, 0) + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{f} double" for f in [*FEATURES, "base"]))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(df)
    gbt = GBTRegressor(featuresCol="x", labelCol="base", maxIter=4, maxDepth=4, seed=1).fit(rows)
    forest = RandomForestRegressor(featuresCol="x", labelCol="base", numTrees=3, maxDepth=4, seed=1).fit(rows)
    return df.drop("base"), rows, {"gbt": gbt, "forest": forest}


def expectation(node, x, known):
    """A tree's value with only the known features: unknown splits pass both ways by their training rows."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    f, at = node.split().featureIndex(), node.split().threshold()
    left, right = node.leftChild(), node.rightChild()
    if f in known:
        return expectation(left if x[f] <= at else right, x, known)
    n = node.impurityStats().count()
    return sum(c.impurityStats().count() / n * expectation(c, x, known) for c in (left, right))


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_shares_equal_all_subsets_and_add_up(fitted, kind):
    df, rows, models = fitted
    model = models[kind]
    weights = list(model.treeWeights) if kind == "gbt" else [1 / 3] * 3
    got = drivers.shares(df, model, FEATURES).collect()
    said = [r["prediction"] for r in model.transform(rows).collect()]
    assert len(got) == len(said)
    for r, p in zip(got, said):
        assert abs(r["base"] + sum(r[f"share_{f}"] for f in FEATURES) - p) < 1e-9
    for r in got[:2]:
        x = [r[f] for f in FEATURES]
        value = {s: sum(w * expectation(t._java_obj.rootNode(), x, s) for w, t in zip(weights, model.trees)) for n in range(6) for s in combinations(range(5), n)}
        for i, f in enumerate(FEATURES):
            others = [j for j in range(5) if j != i]
            want = sum(factorial(n) * factorial(4 - n) / factorial(5) * (value[tuple(sorted((*s, i)))] - value[s]) for n in range(5) for s in combinations(others, n))
            assert abs(r[f"share_{f}"] - want) < 1e-9


def test_mean_shares_and_nulls(fitted, spark):
    df, _, models = fitted
    more = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0)], df.schema))
    out = drivers.shares(more, models["gbt"], FEATURES)
    told = {r["feature"]: r for r in drivers.mean_shares(out, FEATURES).collect()}
    assert abs(sum(r["share_of_all"] for r in told.values()) - 1) < 1e-9 and max(told, key=lambda f: told[f]["mean_abs_share"]) == "a"
    kept = drivers.mean_shares(drivers.shares(df, models["gbt"], FEATURES), FEATURES)
    assert {r["feature"]: r["mean_abs_share"] for r in kept.collect()} == pytest.approx({f: r["mean_abs_share"] for f, r in told.items()})


def test_feature_sets_by_fold(fitted):
    df, rows, _ = fitted
    marked = rows.drop("x").withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("role", F.when(F.rand(3) < 0.7, "train").otherwise("test"))
    scores, moved = drivers.feature_sets(marked, {"one": ["e"], "all": FEATURES}, "base", "fold", "role", 0.0, maxIter=3)
    got = {(r["feature_set"], r["fold"]): r["r2"] for r in scores.collect()}
    assert set(got) == {("one", 1), ("one", 2), ("all", 1), ("all", 2)} and all(got["all", k] > 0.5 > got["one", k] for k in (1, 2))
    assert moved.count() == 12


def grid_of(page, n=0):
    return {(r, c): (text, href) for t, r, c, _, text, href in html.cells_of(page) if t == n}


def test_cells_and_spans():
    page = "<table><tr><th rowspan=2>Year<th colspan='2'>Files <b>all</b></tr><tr><td>x &amp; y<td><a href='/1'>get</a><a href='/2'>no</a></table>"
    assert grid_of(page) == {(0, 0): ("Year", None), (1, 0): ("Year", None), (0, 1): ("Files all", None), (0, 2): ("Files all", None), (1, 1): ("x & y", None), (1, 2): ("getno", "/1")}
    nested = "<table><tr><td>out<table><tr><td>in</td></tr></table>side</td></tr></table><table><tr><td>next"
    assert grid_of(nested, 0) == {(0, 0): ("outside", None)} and grid_of(nested, 1) == {(0, 0): ("in", None)} and grid_of(nested, 2) == {(0, 0): ("next", None)}
    assert html.cells_of("<script>'<table><tr><td>'</script><p>none") == [] and html.cells_of(None) == [] == html.cells_of("")
    assert grid_of("<table><tr><td colspan=99999999>a</table>") == {(0, c): ("a", None) for c in range(html.MOST_SPAN)}
    assert grid_of("<table><tr><td colspan=x rowspan=0>a</table>") == {(0, 0): ("a", None)}


def test_columns_are_found_by_label_wherever_they_stand(spark):
    pages = [
        (1, "<table><tr><th>Kind</th><th>Group</th><th>Download</th></tr><tr><td>hours</td><td>isles</td><td><a href='u/1'>go</a></td></tr><tr><td>hours</td><td>all</td><td></td></tr></table>", "x"),
        (2, "<table><tr><th>Year</th><th>Kind</th><th>Download</th></tr><tr><td>1982</td><td>hours</td><td><a href='u/2'>go</a></td></tr></table>", "x"),
        (3, "<table><tr><td>other</td></tr><tr><td>1</td></tr></table>", "x"),
        (4, None, "x"),
    ]
    df = spark.createDataFrame(pages, "page int, html string, text string")
    rows = html.by_label(html.table_cells(df, "page", "html"), "page", {"kind": "Kind", "year": "Year", "group": "Group"}, {"link": "Download"}, ["link"])
    assert sorted((r["page"], r["kind"], r["year"], r["group"], r["link"]) for r in rows.collect()) == [(1, "hours", None, "isles", "u/1"), (2, "hours", "1982", None, "u/2")]
