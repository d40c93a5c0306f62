"""Readers: sniffed CSV, XLSX, Parquet with row ids, JSON feeds, XML, GeoJSON, checksums."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.parse import excel_date
from millrace.functions.text import MISSING_TABLE, norm_missing, trimmed_headers

DELIMITERS = (",", ";", "\t", "|")


def first_lines(spark: SparkSession, path: str, n: int = 50) -> list[str]:
    """The first lines of a text file, read by Spark so that any store works."""
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def split_quoted(line: str, sep: str) -> list[str]:
    """Cells of one line; quotes protect separators and are doubled inside."""
    cells, cell, inside, i = [], "", False, 0
    while i < len(line):
        ch = line[i]
        if ch == '"':
            if inside and line[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            else:
                inside = not inside
        elif ch == sep and not inside:
            cells.append(cell)
            cell = ""
        else:
            cell += ch
        i += 1
    return [*cells, cell]


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that gives most lines the header's width, oversized lines counting double against it."""
    def score(sep: str):
        widths = [len(split_quoted(x, sep)) for x in lines if x.strip()]
        if not widths or widths[0] < 2:
            return (-(10**9), 0)
        return sum(w == widths[0] for w in widths) - 2 * sum(w > widths[0] for w in widths), widths[0]

    return max(DELIMITERS, key=score)


def frequent_delimiter(line: str) -> str:
    """The commonest delimiter outside quotes in a header."""
    bare = re.sub('"[^"]*"', "", line)
    counts = Counter({d: bare.count(d) for d in DELIMITERS})
    return max(DELIMITERS, key=lambda d: counts[d])


def read_csv(spark: SparkSession, path: str, sep: str | None = None, tokens: tuple[str, ...] | None = None, strict: bool = False, cut_wide: bool = False) -> DataFrame:
    """All-string CSV with quoted multi-line cells; short rows are padded with nulls.

    A file with rows wider than the header is rejected, unless ``cut_wide`` asks
    for their surplus cells to be cut. ``strict`` also rejects files without a
    row. ``tokens`` become nulls.
    """
    head = first_lines(spark, path)
    if not head:
        raise ValueError("the file is empty")
    sep = sep or sniff_delimiter(head)
    names = trimmed_headers(split_quoted(head[0].lstrip("﻿").rstrip("\r"), sep))
    wide = [*names, "_extra"]
    rows = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', schema=", ".join(f"`{n}` string" for n in wide), enforceSchema=True)
    if strict and not rows.limit(1).count():
        raise ValueError("the file needs a header and a row")
    if not cut_wide and rows.filter("_extra IS NOT NULL").limit(1).count():
        raise ValueError("the file has rows wider than its header")
    rows = rows.drop("_extra")
    return rows.select(*[norm_missing(F.col(f"`{c}`"), tokens).alias(c) for c in names]) if tokens is not None else rows


def blank_rows(spark: SparkSession, path: str) -> int:
    """Lines without text, which CSV parsing drops."""
    return spark.read.text(path).filter(F.trim("value") == "").count()


def read_strings(spark: SparkSession, path: str, missing: str = "") -> DataFrame:
    """CSV as text alone, absent cells as ``missing``."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(missing)).alias(c) for c in df.columns])


MOST_UNPACKED, MOST_PARTS = 256 << 20, 2000
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes, sheet: int = 1):
    """Rows of cached cell values of one worksheet; refuses document types and oversized archives."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if len(z.infolist()) > MOST_PARTS or sum(i.file_size for i in z.infolist()) > MOST_UNPACKED:
            raise ValueError("the workbook is too large")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == MAIN + "si":
                        shared.append("".join(t.text or "" for t in e.iter(MAIN + "t")))
                        e.clear()
        name = f"xl/worksheets/sheet{sheet}.xml"
        with z.open(name) as f:
            if b"<!DOCTYPE" in f.read(2048).upper():
                raise ValueError("document types are not allowed")
        with z.open(name) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != MAIN + "row":
                    continue
                cells: dict[int, str | None] = {}
                for c in e.iter(MAIN + "c"):
                    column = 0
                    for ch in re.match("[A-Z]+", c.get("r") or "A")[0]:
                        column = column * 26 + ord(ch) - 64
                    kind = c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(MAIN + "t"))
                    else:
                        v = c.find(MAIN + "v")
                        text = None if v is None else v.text
                        if kind == "s" and text is not None:
                            text = shared[int(text)]
                    cells[column - 1] = text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                e.clear()


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1, names: list[str] | None = None, cut_wide: bool = False) -> DataFrame:
    """All-string rows of a worksheet of one or many workbooks; the first row of the first names the columns.

    A row with cells beyond those columns fails the read, unless ``cut_wide`` asks for them to be cut.
    """
    import pandas as pd

    files = spark.read.format("binaryFile").load(path)
    if names is None:
        names = trimmed_headers([x or "" for x in next(sheet_rows(bytes(files.select("content").first()[0]), sheet))])
    width = len(names)

    def parse(batches):
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                rows = sheet_rows(bytes(content), sheet)
                next(rows, None)
                part = []
                for i, row in enumerate(rows):
                    if not cut_wide and any(row[width:]):
                        raise ValueError(f"row {i + 2} of {where} is wider than the header")
                    part.append([where, i, *[*row, *[None] * width][:width]])
                    if len(part) == 4096:
                        yield pd.DataFrame(part, columns=["_file", "_row", *names])
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=["_file", "_row", *names])

    schema = "_file string, _row long, " + ", ".join(f"`{n}` string" for n in names)
    return files.select("path", "content").mapInPandas(parse, schema)


def excel_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: excel_date(F.col(c).try_cast("double")) for c in columns})


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet with ``_file`` and ``_row``: the file and the row's place in it."""
    return spark.read.parquet(*paths).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows by the files' footers: no column is read."""
    return spark.read.parquet(path).count()


def read_feed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of records, or one record a line."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_xml(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).load(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, ring) of each polygon's outer rings."""
    polygon = "array<array<array<double>>>"
    schema = "features array<struct<properties:struct<code:string,name:string>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    g = F.col("f.geometry")
    one = F.array(F.from_json(g["coordinates"], polygon))
    many = F.from_json(g["coordinates"], f"array<{polygon}>")
    parts = F.when(g["type"] == "Polygon", one).otherwise(many)
    return rows.select(F.col("f.properties.code").alias("code"), F.col("f.properties.name").alias("name"), F.explode(parts).alias("p")).select("code", "name", F.col("p")[0].alias("ring"))


def demo_series(spark: SparkSession, days: int = 1096) -> DataFrame:
    """A synthetic daily series with trend, week, year and noise."""
    i = F.col("id").cast("double")
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int"))
    sales = 1800 + i * 1.1 + 290 * F.sin(2 * F.pi() * F.weekday(day) / 7) + 100 * F.sin(2 * F.pi() * i / 365.25) + 95 * F.randn(42)
    peak = F.when(F.dayofmonth(day).isin(1, 15) & F.month(day).isin(1, 6, 11, 12), 450).otherwise(0)
    return spark.range(days).select(day.alias("date"), F.round(sales + peak, 2).alias("sales"), F.lit("Online").alias("channel"))


def default_missing(df: DataFrame) -> DataFrame:
    return df.select(*[norm_missing(F.col(c), MISSING_TABLE).alias(c) for c in df.columns])
