"""Reading yearly archives: members of zip files, spreadsheets and text in many encodings, wide hours to long rows.

Archives are read by Spark's binaryFile source, so any store that Spark reads will do, and
unpacked inside tasks. Headers are told apart by their labels, not their places.
"""

from __future__ import annotations

import csv
import io
import zipfile
from itertools import chain, islice, repeat
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.flags import parse_cell

# The archives' encodings in the order to try, their dates, and their column labels.
ENCODINGS = ("utf-8-sig", "utf-8", "cp950", "big5", "gb18030")
DATES = ("yyyy/M/d", "M/d/yyyy", "yyyy-M-d")
LABELS = {"date": ("日期", "監測日期", "date"), "station": ("測站", "測站名稱", "station"), "item": ("測項", "測項簡稱", "item")}
_ODS = {name: "{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % name for name in ("table", "office", "text")}
_PRECEDENCE = {"csv": 0, "ods": 1}


def decode(data: bytes) -> str:
    """Text by the first encoding that fits, else UTF-8 with replacement marks."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def select_members(names: list[str]) -> list[str]:
    """One member for each stem, csv before ods; other kinds are left out."""
    best: dict[str, str] = {}
    for name in sorted(names):
        stem, _, kind = name.rpartition(".")
        kind = kind.lower()
        if kind in _PRECEDENCE and (stem not in best or _PRECEDENCE[kind] < _PRECEDENCE[best[stem].rpartition(".")[2].lower()]):
            best[stem] = name
    return [best[s] for s in sorted(best)]


def csv_rows(data: bytes) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(decode(data))) if any(c.strip() for c in r)]


def _ods_groups(row) -> list[tuple[str, int]]:
    """(text, how many columns) of a spreadsheet row's cells up to the last that isn't blank; cells under a merged one are blank."""
    groups = []
    for cell in row:
        kind = cell.tag.rpartition("}")[2]
        if kind in ("table-cell", "covered-table-cell"):
            given = cell.get(f"{_ODS['office']}value")
            said = given if given is not None else "".join("".join(p.itertext()) for p in cell.iterfind(f"{_ODS['text']}p"))
            groups.append((said if kind == "table-cell" else "", int(cell.get(f"{_ODS['table']}number-columns-repeated", 1))))
    last = max((k for k, (said, _) in enumerate(groups) if said.strip()), default=-1)
    return groups[: last + 1]


#: Rows that a sheet can have: one that says it repeats a row beyond that is damaged.
MOST_ROWS = 1 << 20
#: Cells of a frame that a member is read into.
CELLS = 48_000


def ods_rows(data: bytes) -> list[list[str]]:
    """Rows of a spreadsheet's first table, blank ones left out; the first row's width bounds all others, so cells repeated to the sheet's edge cost nothing."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = ElementTree.fromstring(z.read("content.xml")).find(f".//{_ODS['table']}table")
    rows: list[list[str]] = []
    for element in [] if sheet is None else sheet.iter(f"{_ODS['table']}table-row"):
        groups = _ods_groups(element)
        if groups:
            cells = chain.from_iterable(repeat(said, n) for said, n in groups)
            row = list(islice(cells, len(rows[0]))) if rows else list(cells)
            times = int(element.get(f"{_ODS['table']}number-rows-repeated", 1))
            if len(rows) + times > MOST_ROWS:
                raise ValueError(f"more than {MOST_ROWS} rows")
            rows += [row] * times
    return rows


class Dialect(NamedTuple):
    date: str
    station: str
    item: str
    hours: dict[str, int]  # column -> hour of day


def detect_dialect(headers: list[str]) -> Dialect:
    """Which columns hold date, station, item and hours; hours are labelled 0-23, or 1-24 (then an hour less)."""
    clean = {h: h.strip().lower() for h in headers}
    found = {}
    for role, names in LABELS.items():
        got = [h for h in headers if clean[h] in names]
        if len(got) != 1:
            raise ValueError(f"{len(got)} columns for {role}")
        found[role] = got[0]
    numbers = {h: int(clean[h]) for h in headers if clean[h].isdigit() and int(clean[h]) <= 24}
    shift = 1 if 24 in numbers.values() and 0 not in numbers.values() else 0
    hours = {h: n - shift for h, n in numbers.items()}
    if sorted(hours.values()) != list(range(24)):
        raise ValueError("hour columns don't make a day")
    return Dialect(found["date"], found["station"], found["item"], hours)


def _day(text):
    """A date in one of the archives' forms, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATES))


def to_long(wide: DataFrame, dialect: Dialect) -> DataFrame:
    """station, item, ts, value, flag, value_retained: one row for each hour cell; rows without a readable date go."""
    raw = wide.unpivot([dialect.date, dialect.station, dialect.item], list(dialect.hours), "__hour", "__raw")
    day = _day(F.trim(dialect.date))
    hour = F.create_map(*(F.lit(x) for kv in dialect.hours.items() for x in kv))[F.col("__hour")]
    ts = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)
    return raw.select(F.trim(dialect.station).alias("station"), F.trim(dialect.item).alias("item"), ts.alias("ts"), parse_cell("__raw").alias("c")).where("ts is not null").select("station", "item", "ts", "c.*")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content of every readable member of the zip archives under path, one at a time; an archive without any is an error."""

    def unpack(batches):
        for pdf in batches:
            for archive, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = select_members(z.namelist())
                    if not names:
                        raise ValueError(f"{archive}: no member can be read")
                    for name in names:
                        yield pd.DataFrame([(archive, name, z.read(name))], columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, member string, content binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """member, station, item, date, hour and raw text of every cell in the zip archives under path.

    Opening an archive is one task's work; its members are then dealt out, so that those of one
    archive are read by many tasks, each in frames of CELLS cells. A member that can't be read fails with its
    name.
    """

    def parse(batches):
        for pdf in batches:
            for name, data in zip(pdf["member"], pdf["content"]):
                try:
                    rows = (csv_rows if name.lower().endswith("csv") else ods_rows)(data)
                    d = detect_dialect(rows[0])
                except (ValueError, IndexError, KeyError) as e:
                    raise ValueError(f"{name}: {e}") from e
                at, wide = {h: i for i, h in enumerate(rows[0])}, len(rows[0])
                step = max(1, CELLS // len(d.hours))
                for k in range(1, len(rows), step):
                    out = []
                    for r in rows[k : k + step]:
                        r = r[:wide] + [""] * (wide - len(r))
                        out += [(name, r[at[d.station]].strip(), r[at[d.item]].strip(), r[at[d.date]].strip(), hour, r[at[h]]) for h, hour in d.hours.items()]
                    yield pd.DataFrame(out, columns=["member", "station", "item", "date", "hour", "raw"])

    dealt = archive_members(spark, path).repartition("archive", "member").select("member", "content")
    return dealt.mapInPandas(parse, "member string, station string, item string, date string, hour int, raw string")


def cells_to_observations(cells: DataFrame) -> DataFrame:
    """Cells of `read_archives` as long observations."""
    day = _day(F.col("date"))
    ts = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), "hour")
    return cells.select("member", "station", "item", ts.alias("ts"), parse_cell("raw").alias("c")).where("ts is not null").select("member", "station", "item", "ts", "c.*")


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with exactly these string columns; blank is null; a ragged line fails."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("emptyValue", "").option("nullValue", "").csv(path)


def sensor_observations(raw: DataFrame) -> DataFrame:
    """Typed sensor rows: numbers and times by try_cast, and whether coordinates are valid (null where there are none)."""
    lon, lat = F.col("lon").try_cast("double"), F.col("lat").try_cast("double")
    valid = F.when(F.col("lon").isNotNull() | F.col("lat").isNotNull(), F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False)))
    return raw.select("device_id", "variable", F.col("ts").try_cast("timestamp_ntz").alias("ts"), F.col("value").try_cast("double").alias("value"), lon.alias("lon"), lat.alias("lat"), valid.alias("coordinate_valid"))
