"""Tables and links out of HTML pages, columns by their header's label, with spans resolved; pages are read in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a row or column span may cover; more is a fault of the page, not a table.
MOST_SPAN = 1000


class _Tables(HTMLParser):
    """Cells of every table in order: (table, row, column, is header, text, first link). Inner tables count as tables of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple] = []
        self.open: list[dict] = []
        self.tables = 0
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.open.append({"n": self.tables, "row": -1, "column": 0, "cell": None, "taken": {}})
            self.tables += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._close(t)
                t["row"], t["column"] = t["row"] + 1, 0
            elif tag in ("td", "th"):
                self._close(t)
                t["row"] = max(t["row"], 0)
                span = [min(int(v), MOST_SPAN) if (v := (attrs.get(k) or "1").strip()).isascii() and v.isdigit() and int(v) else 1 for k in ("colspan", "rowspan")]
                while t["taken"].get(t["column"], 0) > t["row"]:
                    t["column"] += 1
                t["cell"] = {"at": t["column"], "span": span, "head": tag == "th", "text": [], "href": None}
            elif tag == "a" and t["cell"] is not None and t["cell"]["href"] is None:
                t["cell"]["href"] = attrs.get("href")

    def handle_startendtag(self, tag, attrs):
        if tag not in ("script", "style", "table", "tr", "td", "th"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.open and tag in ("td", "th", "tr"):
            self._close(self.open[-1])
        elif self.open and tag == "table":
            self._close(self.open.pop())

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None and not self.silent:
            self.open[-1]["cell"]["text"].append(data)

    def _close(self, t) -> None:
        """The open cell goes to every place that it spans."""
        cell, t["cell"] = t["cell"], None
        if cell is None:
            return
        wide, high = cell["span"]
        text = " ".join("".join(cell["text"]).split())
        for c in range(cell["at"], cell["at"] + wide):
            t["taken"][c] = t["row"] + high
            for r in range(t["row"], t["row"] + high):
                self.cells.append((t["n"], r, c, cell["head"], text, cell["href"]))
        t["column"] = cell["at"] + wide

    def close(self):
        super().close()
        while self.open:
            self._close(self.open.pop())


def cells_of(html: str | None) -> list[tuple]:
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return parser.cells


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, row, column, header, text, href: a row for each place of each table's grid. Pages without a table, null ones too, have none; broken markup gives the cells that can be read."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, *cell) for k, page in zip(b["key"], b["html"]) for cell in cells_of(page)]
            yield pd.DataFrame(found, columns=["key", "table", "row", "column", "header", "text", "href"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    out = rows.mapInPandas(run, f"key {kind}, table int, row int, column int, header boolean, text string, href string")
    return out.withColumnRenamed("key", key)


def by_label(cells: DataFrame, key: str, labels: dict[str, str], links: dict[str, str] | None = None, required: list[str] | None = None) -> DataFrame:
    """key, table, row and a column for each of `labels` (name -> header's label), with links' targets for `links`.

    The first row of a table names its columns, wherever they stand; a label that is missing gives
    nulls, one that occurs twice counts where it stands first. Rows that lack one of `required` names (null or
    empty) are left out, and so are tables without any of the labels.
    """
    wanted = {**{n: (label, "text") for n, label in labels.items()}, **{n: (label, "href") for n, label in (links or {}).items()}}
    heads = cells.where("row = 0").where(F.col("text").isin(*{label for label, _ in wanted.values()}))
    heads = heads.groupBy(key, "table", F.col("text").alias("__label")).agg(F.min("column").alias("column"))
    met = cells.where("row > 0").join(heads, [key, "table", "column"])
    rows = met.groupBy(key, "table", "row").agg(*(F.max(F.when(F.col("__label") == label, F.col(what))).alias(n) for n, (label, what) in wanted.items()))
    for n in required or []:
        rows = rows.where(F.col(n).isNotNull() & (F.col(n) != ""))
    return rows
