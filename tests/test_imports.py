"""Settings, imports, manifests, numbering and pitfalls."""

import datetime as dt
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from aerolith.operators import audits, pitfalls, windows
from aerolith.sources import config, imports


def test_yaml_keys_that_read_as_booleans():
    pytest.importorskip("yaml")
    assert config.read_yaml("'NO': {low: 0}\nO3: 1") == {"NO": {"low": 0}, "O3": 1}
    with pytest.raises(ValueError):
        config.read_yaml("a:\n  NO: 1")


def test_settings_refuse(spark):
    day = dt.date(2015, 1, 1)
    ok = config.events(spark, [{"name": "x", "start": day, "end": day, "status": "verified", "source": "paper"}])
    assert ok.count() == 1
    for bad in ([{"name": "x", "start": day, "end": day, "status": "verified"}], [{"name": "x", "start": day}], [{"name": "x", "start": day, "end": dt.date(2014, 1, 1)}], [{"name": "x", "start": day, "end": day, "odd": 1}], [{"name": "x", "start": day, "end": day}] * 2):
        with pytest.raises(ValueError):
            config.events(spark, bad)


def test_complete_keys(spark):
    expected = spark.createDataFrame([(1,), (2,)], "k int")
    assert imports.complete(expected, expected, ["k"]).count() == 2
    with pytest.raises(ValueError, match="missing"):
        imports.complete(spark.createDataFrame([(1,), (1,), (3,)], "k int"), expected, ["k"])


def test_archive_listing_and_manifest(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/a.csv", "abc")
        z.writestr("../b.csv", "")
    got = {r["member"]: (r["bytes"], r["safe"]) for r in imports.describe_archives(spark, str(tmp_path)).collect()}
    assert got == {"x/a.csv": (3, True), "../b.csv": (0, False)}
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    one = imports.manifest({"t": a})["t"]
    assert one == imports.manifest({"t": a.orderBy(F.desc("k")).select("v", "k")})["t"] and one["rows"] == 2
    assert one["checksum"] != imports.manifest({"t": a.where("k = 1")})["t"]["checksum"]


def test_csv_upsert(spark, tmp_path):
    from aerolith.sources.stores import write_csv

    write_csv(spark.createDataFrame([(2014, 1), (2015, 2)], "year int, n int"), str(tmp_path / "old"))
    new = spark.createDataFrame([(2015, 9), (2016, 3)], "year int, n int")
    imports.upsert_csv(spark, new, str(tmp_path / "old"), ["year"], str(tmp_path / "new"))
    got = spark.read.option("header", True).schema("year int, n int").csv(str(tmp_path / "new"))
    assert sorted(map(tuple, got.collect())) == [(2014, 1), (2015, 9), (2016, 3)]


def test_numbering_is_a_total_order(spark):
    rng = random.Random(1)
    rows = [(dt.datetime(2015, 1, rng.randint(1, 9), rng.randint(0, 23)), i) for i in range(300)] + [(None, 999)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k int")
    got = [r["k"] for r in windows.numbered(df, ["ts", "k"], F.to_date("ts"), "n").orderBy("n").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or dt.datetime.min, r[1]))]


def test_joint_folds_leave_no_leak(spark):
    rows = spark.createDataFrame([(i, i % 5, 1 + i % 4) for i in range(40)], "k int, sf int, q int")
    out = audits.held_out_design(rows, "sf", "q", 5).where("design = 'joint'").collect()
    for r in out:
        if r["role"] == "train":
            assert r["sf"] != r["held_station_fold"] and r["q"] != r["held_quarter"]
    assert sum(r["role"] == "test" for r in out) == 40


def test_collapse_refuses_two_truths(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.5, 2.0)], "k int, y double, p double")
    with pytest.raises(Exception, match="more than one truth"):
        audits.collapse_predictions(df, ["k"], "y", "p").collect()


def test_pitfalls(spark):
    rng = random.Random(3)
    rows = [(i, b, 10 + 5 * __import__("math").cos(b * 3.14159 / 180) + rng.gauss(0, 0.1), x, x + rng.gauss(0, 1), i % 3) for i in range(600) for b, x in [(rng.uniform(0, 360), rng.random())]]
    df = spark.createDataFrame(rows, "k int, b double, y double, x double, z double, fold int")
    r = pitfalls.encoding_gain(df, "y", "b").first()
    assert r["r2_raw"] < 0.2 and r["r2_encoded"] > 0.95
    lk = pitfalls.leakage_price(df, "z", ["b"], "x").first()
    assert lk["r2_with"] >= lk["r2_without"]
    assert pitfalls.optimism(df, "z", ["x"], "fold").count() == 3
    s = {r["term"]: r["same_sign"] for r in pitfalls.sign_stability(df, "z", ["x"], ["k"]).collect()}
    assert s["x"] >= 0.9
