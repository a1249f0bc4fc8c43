"""Archives, stores, exports, streams and jobs, end to end on small files."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from aerolith.functions.flags import FLAGS
from aerolith.plans import jobs
from aerolith.sources import archives, stores
from aerolith.streaming import windows

HOURS = [f"{h:02d}" for h in range(24)]


def sheet(rows):
    t = 'xmlns:%s="urn:oasis:names:tc:opendocument:xmlns:%s:1.0"'
    head = " ".join(t % (a, a) for a in ("office", "table", "text"))
    body = "".join("<table:table-row>" + "".join(f"<table:table-cell{r}><text:p>{v}</text:p></table:table-cell>" for v, r in row) + "</table:table-row>" for row in rows)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("content.xml", f'<office:x {head}><table:table>{body}</table:table><table:table><table:table-row><table:table-cell><text:p>no</text:p></table:table-cell></table:table-row></table:table></office:x>')
    return z.getvalue()


@pytest.fixture
def archive(tmp_path):
    text = "日期,測站,測項," + ",".join(HOURS) + "\n2015/01/02,甲,PM2.5," + ",".join(["12", "15#", "NR", "", "900"] + ["3.5"] * 19) + "\n2015/01/02,甲,WIND," + ",".join(["888"] * 24) + "\nbad,甲,PM2.5" + ",1" * 24 + "\n"
    other = sheet([[("date", ""), ("station", ""), ("item", ""), *((str(h), "") for h in range(1, 25))], [("2015-02-03", ""), ("B", ""), ("RAIN", ""), ("NR", ' table:number-columns-repeated="24"')]])
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("a/one.csv", text.encode("cp950"))
        z.writestr("a/one.ods", b"not read, csv comes first")
        z.writestr("b/two.ods", other)
        z.writestr("readme.txt", "skip me")
    return str(tmp_path / "y.zip")


def test_members_and_encodings():
    assert archives.select_members(["x/a.ods", "x/a.CSV", "b.ods", "c.txt"]) == ["b.ods", "x/a.CSV"]
    assert archives.decode("測站".encode("cp950")) == "測站" and archives.decode("﻿é".encode()) == "é"
    assert "�" in archives.decode(b"\xff\xff\xff\x81")


def test_dialects():
    d = archives.detect_dialect(["date", "Station", "item", *(str(h) for h in range(1, 25))])
    assert d.hours["1"] == 0 and d.hours["24"] == 23
    assert archives.detect_dialect(["日期", "測站", "測項", *HOURS]).hours["07"] == 7
    with pytest.raises(ValueError):
        archives.detect_dialect(["date", "station", "item", *HOURS[:-1]])
    with pytest.raises(ValueError):
        archives.detect_dialect(["date", "item", *HOURS])


def test_wide_to_long(spark):
    wide = spark.createDataFrame([("2015/1/2", " s ", "PM", *map(str, range(24))), ("1/3/2015", "s", "PM", *["#"] * 24), ("?", "s", "PM", *["1"] * 24)], ["date", "station", "item", *HOURS])
    out = archives.to_long(wide, archives.detect_dialect(wide.columns))
    assert out.count() == 48
    r = out.where("value = 23").first()
    assert r["ts"] == dt.datetime(2015, 1, 2, 23) and r["station"] == "s" and r["flag"] == "valid"


def test_build_store_repair_and_aggregate(spark, archive, tmp_path):
    store = str(tmp_path / "store")
    summary = jobs.build(spark, archive, store, FLAGS, {"WIND": {888: "calm"}}, ["RAIN"], {"PM2.5": (0, 500)}).collect()
    assert [(r["year"], r["rows"], r["entities"]) for r in summary] == [(2015, 72, 2)]
    kept = {(r["item"], r["ts"].hour): r for r in stores.scan_observations(spark, store).where("month = 1").collect()}
    assert kept["PM2.5", 4]["flag"] == "out_of_range" and kept["PM2.5", 4]["value"] == 900
    assert kept["PM2.5", 1]["value_retained"] and kept["PM2.5", 3]["flag"] == "missing"
    assert kept["WIND", 0]["value"] is None and kept["WIND", 0]["flag"] == "calm"
    rain = stores.scan_observations(spark, store, since="2015-02-01").collect()
    assert len(rain) == 24 and all(r["value"] == 0.0 and r["flag"] == "no_rain" for r in rain)
    jobs.build(spark, archive, store, FLAGS, {"WIND": {888: "calm"}}, ["RAIN"], {"PM2.5": (0, 500)})  # again: the same partitions, replaced
    assert stores.scan_observations(spark, store).count() == 72
    days, months = jobs.aggregates(stores.scan_observations(spark, store), ["WIND"])
    got = {r["item"]: r for r in days.collect()}
    assert got["PM2.5"]["n_valid"] == 20 and got["RAIN"]["mean"] == 0.0 and "WIND" not in got
    assert all(r["mean"] is None for r in months.collect())
    changed = stores.repair(spark, store, str(tmp_path / "staging"), lambda df: df.withColumn("flag", F.when(F.col("value") == 12, "manual_check_invalid").otherwise(F.col("flag"))))
    assert changed == 1 and stores.scan_observations(spark, store).where("flag = 'manual_check_invalid'").count() == 1


def test_store_refuses(spark, tmp_path):
    row = ("s", "i", dt.datetime(2015, 1, 1), None, "valid", False)
    df = spark.createDataFrame([row, row], "station string, item string, ts timestamp_ntz, value double, flag string, value_retained boolean")
    assert stores.problems(stores.conform(df), FLAGS) == {"valid_without_value": 2, "duplicate_keys": 1}
    with pytest.raises(ValueError):
        stores.write_observations(df, str(tmp_path / "x"), FLAGS)
    with pytest.raises(ValueError):
        stores.conform(df.drop("flag"))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", 1, 1.5), ("p", "a", 2, None), ("p", "b", 2, 2.0), ("q", "a", 1, 3.0)], "item string, station string, month int, v double")
    got = {r["item"]: r["json"] for r in stores.rectangle(df, "station", "month", F.col("v"), ["item"]).collect()}
    assert got == {"p": '{"rows":["a","b"],"columns":[1,2],"values":[[1.5,null],[null,2.0]]}', "q": '{"rows":["a"],"columns":[1],"values":[[3.0]]}'}
    stores.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("part*")).read_text().splitlines()
    assert lines[0] == "item,station,month,v" and "p,a,2," in lines
    stores.write_station_days(df, str(tmp_path / "days"), "item", "station", "month")
    assert spark.read.parquet(str(tmp_path / "days")).where("item = 'p'").count() == 3
    df.createOrReplaceTempView("small")
    rows, total, cut = stores.sql(spark, "SELECT * FROM small ORDER BY month", limit=2)
    assert len(rows) == 2 and total == 4 and cut


def test_strict_csv_and_sensor_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text("device_id,variable,ts,value,lon,lat\nd1,pm25,2025-01-01 00:00:00,1.5,121,25\nd2,pm25,x,,999,25\nd3,pm25,2025-01-01 01:00:00,2,,\n")
    raw = archives.strict_csv(spark, str(tmp_path / "s.csv"), "device_id string, variable string, ts string, value string, lon string, lat string")
    got = {r["device_id"]: r for r in archives.sensor_observations(raw).collect()}
    assert got["d1"]["coordinate_valid"] is True and got["d2"]["coordinate_valid"] is False and got["d3"]["coordinate_valid"] is None
    assert got["d2"]["ts"] is None and got["d2"]["value"] is None


def test_stream_of_files(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, d, h), float(h)) for d in (1, 2, 3) for h in range(24) if not (d == 2 and h > 9)]
    schema = "k string, ts timestamp, v double"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = windows.gated_windows(stream, ["k"], "ts", "v").writeStream.format("memory").queryName("gated").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["start"].day: r for r in spark.table("gated").collect()}
    assert got[1]["mean"] == 11.5 and got[2]["mean"] is None and got[2]["n_valid"] == 10
    days = stream.withColumn("day", F.to_date("ts").cast("string"))
    for k in (1, 2):  # a second run with its own checkpoint replaces, and doesn't add
        windows.replace_partitions(days, str(tmp_path / "out"), str(tmp_path / f"ck{k}"), ["day"]).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_excursions_and_backtest(spark):
    t0 = dt.datetime(2015, 1, 1)
    rows = [(s, t0 + dt.timedelta(hours=k), 20.0 + (k % 3) * 2 + (60 if 100 <= k < 103 and s != "c" else 0)) for s in "abc" for k in range(400)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, value double").withColumn("cell", F.lit(1)).withColumn("usable", F.lit(True)).withColumn("rejected", F.lit(False))
    edges = spark.createDataFrame([(a, b) for a in "abc" for b in "abc" if a != b], "station string, neighbour string")
    got = {r["station"]: r for r in jobs.excursions(df, edges, df.select("station"), ["station"], "station", ["station", "cell"], shifts=(-2, 2), stations=2).collect()}
    assert {r["verdict"] for r in got.values()} == {"regional_episode"} and got["a"]["reason"] == "synchronous_rise"
    assert set(got) == {"a", "b"} and got["a"]["elevated"] == 1 and got["a"]["placed"] == 2 and got["a"]["elevated_shifted"] == 0.0
    cuts = spark.sql("SELECT 0 AS fold, timestamp_ntz'2015-01-08' AS test_from, timestamp_ntz'2015-01-12' AS test_to")
    m = {(r["h"], r["model"]): r for r in jobs.backtest(df, ["station"], [1, 3], cuts, 100.0).collect()}
    assert m[3, "persistence"]["rmse"] == 0.0 and m[1, "persistence"]["rmse"] > 1 and m[1, "climatology"]["n"] == m[1, "persistence"]["n"]


def test_spreadsheet_rows_by_the_header_s_width():
    import io
    import zipfile

    ns = "".join(f' xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{k}:1.0"' for k in ("table", "office", "text"))
    cell = lambda t, n=1: f'<table:table-cell table:number-columns-repeated="{n}"><text:p>{t}</text:p></table:table-cell>'
    blank = '<table:table-cell table:number-columns-repeated="16000"/>'
    rows = [
        "<table:table-row>" + cell("a") + cell("b", 100) + cell("c") + blank + "</table:table-row>",
        '<table:table-row table:number-rows-repeated="1000000">' + blank + "</table:table-row>",
        '<table:table-row table:number-rows-repeated="2">' + '<table:table-cell office:value="1.5"><text:p>1,5</text:p></table:table-cell>' + '<table:covered-table-cell/>' + cell("y", 16000) + "</table:table-row>",
    ]
    body = f"<office:document{ns}><table:table>{''.join(rows)}</table:table><table:table><table:table-row>{cell('other')}</table:table-row></table:table></office:document>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("content.xml", body)
    got = archives.ods_rows(held.getvalue())
    assert got[0] == ["a", *["b"] * 100, "c"] and got[1:] == [["1.5", "", *["y"] * 100]] * 2


def test_members_of_one_archive_are_dealt_out(spark, tmp_path):
    import zipfile

    header = "date,station,item," + ",".join(f"{h:02d}" for h in range(24))
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips/year.zip", "w") as z:
        for k in range(200):
            z.writestr(f"{k:03d}.csv", header + "\n" + "".join(f"2016/01/{d + 1:02d},s{k},PM10," + ",".join(str(h) for h in range(24)) + "\n" for d in range(3)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = archives.read_archives(spark, str(tmp_path / "zips"))
        parts = cells.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.countDistinct("member").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and sum(r["n"] for r in parts) == 200  # as many as shuffle partitions
    assert cells.count() == 200 * 3 * 24 and cells.where("station = 's7' and hour = 5").count() == 3
    with zipfile.ZipFile(tmp_path / "zips/none.zip", "w") as z:
        z.writestr("readme.txt", "nothing")
    import pytest

    with pytest.raises(Exception, match="no member can be read"):
        archives.read_archives(spark, str(tmp_path / "zips")).count()
