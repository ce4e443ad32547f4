"""Office Open XML workbooks (.xlsx): the cells of the first sheet, read with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(cell: str) -> int:
    """0 for A1, 25 for Z9, 26 for AA3."""
    n = 0
    for letter in re.match("[A-Z]+", cell).group():
        n = 26 * n + ord(letter) - 64
    return n - 1


def first_sheet(raw: bytes) -> list[list[str | None]]:
    """Rows of cells as text; empty cells are None.  Shared, inline and plain values are read, formulas by their stored value."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SPACE}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{SPACE}t")))
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{SPACE}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{SPACE}c"):
                at = column_number(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = c.find(f"{SPACE}v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{SPACE}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            out.append(cells)
    return out


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row_no (from 0), cells array<string> of the first sheet of each workbook; a workbook is one row of work."""

    def run(frames):
        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"]):
                rows = first_sheet(bytes(raw))
                yield pd.DataFrame({"path": name, "row_no": range(len(rows)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row_no int, cells array<string>")


def xlsx_table(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of one workbook, all columns as text, named by its first row (one small row that the driver reads)."""
    cells = xlsx_cells(spark, path)
    head = cells.filter("row_no = 0").first()
    names = [n if n else f"_c{i}" for i, n in enumerate(head.cells)] if head else []
    body = cells.filter("row_no > 0 and exists(cells, c -> c is not null)")
    return body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
