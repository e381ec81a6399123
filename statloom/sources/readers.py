"""Readers of the supported file kinds, dispatched by extension."""

from __future__ import annotations

import os
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.scalars import header_names
from statloom.operators.ordered import with_position

NA_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "-", "--", "?")


def number(c: Column, decimal: str = ".", na: tuple[str, ...] = NA_TOKENS) -> Column:
    """A cell as a double; missing tokens and text become null."""
    text = F.trim(c)
    text = F.when(~text.isin(*na), text)
    return (F.regexp_replace(F.replace(text, F.lit("."), F.lit("")), ",", ".") if decimal == "," else text).try_cast("double")


def typed(df: DataFrame, decimal: str = ".", na: tuple[str, ...] = NA_TOKENS, share: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns as doubles where at least ``share`` of the present cells (more than it, below 1) are numbers; one pass decides."""
    names = [c for c in df.columns if c not in keep]
    present = lambda c: F.when(~F.trim(c).isin(*na), F.col(c))
    row = df.agg(*[e for c in names for e in (F.count(present(c)), F.count(number(F.col(c), decimal, na)))]).first() if names else ()
    made = {}
    for i, c in enumerate(names):
        all_, numbers = row[2 * i], row[2 * i + 1]
        enough = numbers == all_ if share == 1.0 else numbers > share * all_
        made[c] = number(F.col(c), decimal, na) if all_ and enough else present(c)
    return df.withColumns(made) if made else df


def read_csv(spark: SparkSession, path: str | list[str], separator: str = ",", decimal: str = ".", encoding: str = "UTF-8", header: bool = True, index: bool = False, skip_rows: int = 0, skip_columns: int = 0, na: tuple[str, ...] = NA_TOKENS, quote: str = '"') -> DataFrame:
    """Delimited text: types from the cells, missing tokens as null; ``index`` makes the first column the row id, else ``row_id`` numbers the rows from 1 within the file order."""
    raw = spark.read.csv(path, sep=separator, header=header and not skip_rows, quote=quote, encoding=encoding, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if skip_rows:
        lines = spark.read.option("encoding", encoding).text(path).withColumn("_i", F.monotonically_increasing_id())
        top = lines.orderBy("_i").limit(skip_rows + 1).collect()
        first = top[-1]
        left = lines.where(F.col("_i") >= first["_i"])
        names = [n.strip(quote) for n in first[0].split(separator)] if header else [f"_c{i}" for i in range(first[0].count(separator) + 1)]
        schema = ", ".join(f"`{n}` string" for n in names)
        rows = lines.where(F.col("_i") > first["_i"]) if header else left
        raw = rows.select(F.from_csv("value", schema, {"sep": separator, "quote": quote}).alias("r")).select("r.*")
    if skip_columns and not header:
        raw = raw.select(*raw.columns[skip_columns:])
    if index:
        raw = raw.withColumnRenamed(raw.columns[0], "row_id")
    else:
        raw = with_position(raw.withColumn("_i", F.monotonically_increasing_id()), "_i", "row_id").withColumn("row_id", F.col("row_id") + 1).drop("_i")
    return typed(raw, decimal, na, keep=("row_id",))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_spectral(spark: SparkSession, path: str, **how) -> DataFrame:
    """A delimited table whose columns, if over 100, are renamed to evenly spaced wavelengths from 400 to 4000, else Var_i."""
    df = read_csv(spark, path, **how)
    names = [c for c in df.columns if c != "row_id"]
    new = [f"WL_{w:.1f}" for w in np.linspace(400, 4000, len(names))] if len(names) > 100 else [f"Var_{i + 1}" for i in range(len(names))]
    return df.select("row_id", *[F.col(f"`{a}`").alias(b) for a, b in zip(names, new)])


#: Number formats tried in turn on a binary file, as (little or big endian, kind).
BINARY_FORMATS = ("<f", "<d", "<i", "<h", ">f", ">d", ">i", ">h")


def parse_raw(content: bytes) -> list[list[float]]:
    """Rows of numbers of a text or binary diffraction file; a single column gets an axis from 5 to 80."""
    rows: list[list[float]] = []
    for line in content.decode("utf-8", "replace").replace(";", "").replace(",", ".").splitlines():
        try:
            if cells := [float(t) for t in line.split()]:
                rows.append(cells)
        except ValueError:
            continue
    if not rows:
        for f in BINARY_FORMATS:
            size = struct.calcsize(f)
            values = [v[0] for v in struct.iter_unpack(f, content[: len(content) // size * size])]
            values = [float(v) for v in values if -1e6 < v < 1e6]
            if values:
                rows = [[v] for v in values]
                break
    if rows and max(map(len, rows)) == 1:
        rows = [[a, r[0]] for a, r in zip(np.linspace(5, 80, len(rows)).tolist(), rows)]
    return rows


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(Sample_ID, row, 2Theta, Intensity, Background, status): each file parsed where it lies; a file without numbers gives one row with status Parsing_Failed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path_, content in zip(p.path, p.content):
                stem = os.path.splitext(os.path.basename(path_))[0]
                rows = parse_raw(bytes(content))
                cell = lambda r, i: r[i] if len(r) > i else None
                out = [(stem, i + 1, *(cell(r, k) for k in range(3)), "ok") for i, r in enumerate(rows)] or [(stem, 0, None, None, None, "Parsing_Failed")]
                yield pd.DataFrame(out, columns=["Sample_ID", "row", "2Theta", "Intensity", "Background", "status"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "Sample_ID string, row bigint, `2Theta` double, Intensity double, Background double, status string")


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0, skip_rows: int = 0, header: bool = True, index: bool = False) -> DataFrame:
    """One sheet, read on the driver (a workbook cannot be split); needs a library that pandas can read workbooks with."""
    try:
        data = pd.read_excel(path, sheet_name=sheet, skiprows=skip_rows, header=0 if header else None, index_col=0 if index else None)
    except ImportError as e:
        raise ValueError("reading workbooks needs openpyxl or xlrd, which are not installed") from e
    data.columns = header_names([str(c) for c in data.columns])
    return spark.createDataFrame(data.reset_index(names="row_id") if index else data.assign(row_id=range(1, len(data) + 1)))


def parse_clipboard(spark: SparkSession, text: str, separator: str | None = None, decimal: str = ".", header: bool = True, na: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """A pasted table: the separator is the most frequent of tab, comma and semicolon in the first line; short rows are filled with empty cells; a column is numeric if over half of its cells are."""
    lines = [x for x in text.splitlines() if x.strip()]
    count = Counter({s: lines[0].count(s) for s in ("\t", ",", ";")})
    sep = separator or (max(count, key=count.get) if any(count.values()) else ",")
    cells = [x.split(sep) for x in lines]
    width = max(map(len, cells))
    cells = [c + [""] * (width - len(c)) for c in cells]
    names = header_names(cells[0]) if header else [f"Var_{i + 1}" for i in range(width)]
    body = cells[1:] if header else cells
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(body)], "row_id bigint, " + ", ".join(f"`{n}` string" for n in names))
    return typed(df, decimal, na, share=0.5, keep=("row_id",))


def _unsupported(kind: str) -> Callable:
    def reader(spark: SparkSession, path: str, **how) -> DataFrame:
        raise ValueError(f"{kind} files are not supported")

    return reader


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": read_csv, ".txt": read_csv, ".tsv": lambda s, p, **h: read_csv(s, p, **{"separator": "\t", **h}), ".prn": read_csv, ".dat": read_spectral, ".asc": read_spectral, ".raw": read_raw, ".xrd": read_raw, ".json": read_json, ".xlsx": read_excel, ".xls": read_excel,
    ".parquet": lambda s, p, **h: s.read.parquet(p), **{k: _unsupported(k) for k in (".sam", ".spc", ".jdx", ".dx", ".arff", ".ods", ".h5", ".hdf5", ".mat")},
}


def read(spark: SparkSession, path: str, **how) -> DataFrame:
    """The reader of the path's extension."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {kind or path}")
    return READERS[kind](spark, path, **how)


def read_many(spark: SparkSession, paths: list[str], **how) -> DataFrame:
    """Several files below each other; columns that a file lacks are null."""
    out = read(spark, paths[0], **how)
    for p in paths[1:]:
        out = out.unionByName(read(spark, p, **how), allowMissingColumns=True)
    return out
