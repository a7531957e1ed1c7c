"""Reading statements: every cell stays text, and every row keeps where it came from."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import is_summary_row, promote_header

ROW = "source_row_number"


def numbered_rows(df: DataFrame, first: int) -> DataFrame:
    """``df``, just read from files, with source_file and source_row_number: a row's place in its file, counted from ``first``.

    Rows of a block lie one after the other, so a block's rows are counted and the sum over the blocks before is added; no
    file is brought into one task for it. One row per block is joined back.
    """
    cols = df.columns
    read = df.select(*[F.col(f"`{c}`") for c in cols], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    blocks = read.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    upto = W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("__file").alias("__f"), F.col("__block").alias("__b"), "__first", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    out = read.join(blocks, (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    return out.select(*[F.col(f"`{c}`") for c in cols], F.element_at(F.split("__file", "/"), -1).alias("source_file"), (F.col("__id") - F.col("__first") + F.col("__before") + first).alias(ROW))


def read_csv(spark: SparkSession, path: str, summaries: bool = False, multi_line: bool = True) -> DataFrame:
    """A CSV file or folder: text columns, source_file and source_row_number (from 2, by place in the file). Summary rows are left out.

    With ``multi_line`` quoted cells may hold line ends, and a file is read by one task; files without such cells can be read in blocks.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    cols = df.columns
    df = numbered_rows(df, 2)
    return df if summaries else df.where(~is_summary_row(*[F.col(f"`{c}`") for c in cols]))


def read_headerless(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose header stands in one of its first rows."""
    df = numbered_rows(spark.read.csv(path, header=False, inferSchema=False, multiLine=True, escape='"'), 1)
    return promote_header(df.drop("source_file"), ROW)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(transaction_date, amount, description) of text lines that hold a date; the amount is the line's last number."""
    line = F.col("value")
    date = F.regexp_extract(line, r"(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4})", 1)
    amounts = F.regexp_extract_all(line, F.lit(r"(-?[\d,]+\.\d{2})"), 1)
    return spark.read.text(path).where((date != "") & (F.size(amounts) > 0)).select(date.alias("transaction_date"), F.element_at(amounts, -1).alias("amount"), F.trim(line).alias("description"))


def read_excel(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every sheet of a workbook as text; needs a library that reads workbooks."""
    if not importlib.util.find_spec("openpyxl"):
        raise ValueError("reading workbooks needs openpyxl, which isn't installed")
    import pandas as pd

    return {name: spark.createDataFrame(sheet.astype(str)) for name, sheet in pd.read_excel(path, sheet_name=None, dtype=str).items()}


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """The text lines of PDF files as ``read_text_lines`` reads them; needs a library that reads PDF."""
    if not importlib.util.find_spec("pdfplumber"):
        raise ValueError("reading PDF needs pdfplumber, which isn't installed")

    def lines(batches):
        import io

        import pandas as pd
        import pdfplumber

        for batch in batches:
            for data in batch["content"]:
                with pdfplumber.open(io.BytesIO(data)) as pdf:
                    yield pd.DataFrame({"value": [x for page in pdf.pages for x in (page.extract_text() or "").splitlines()]})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string")
    date = F.regexp_extract("value", r"(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4})", 1)
    amounts = F.regexp_extract_all("value", F.lit(r"(-?[\d,]+\.\d{2})"), 1)
    return raw.where((date != "") & (F.size(amounts) > 0)).select(date.alias("transaction_date"), F.element_at(amounts, -1).alias("amount"), F.trim("value").alias("description"))


_READERS = {".csv": read_csv, ".txt": read_text_lines, ".pdf": read_pdf, ".parquet": lambda spark, path: spark.read.parquet(path), ".json": lambda spark, path: spark.read.json(path)}


def read_statement(spark: SparkSession, path: str) -> DataFrame:
    """A statement by its file's ending; ValueError for a missing file or an unknown ending."""
    ending = os.path.splitext(path)[1].lower()
    if "://" not in path and not os.path.exists(path):
        raise ValueError(f"no such file: {path}")
    if ending in (".xlsx", ".xls"):
        return next(iter(read_excel(spark, path).values()))
    if ending not in _READERS:
        raise ValueError(f"no reader for {ending or 'a file without ending'}")
    return _READERS[ending](spark, path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The file, or no rows of the schema where it is missing or empty."""
    try:
        return spark.read.csv(path, header=True, schema=schema) if path.endswith(".csv") else spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return spark.createDataFrame([], schema)
        raise


def read_directory(spark: SparkSession, path: str) -> list[tuple[str, bool, DataFrame]]:
    """(name, is_primary, rows) of the readable files of a folder by name; primary is the one called bank or primary, else the first."""
    names = sorted(n for n in os.listdir(path) if not n.startswith(".") and os.path.splitext(n)[1].lower() in _READERS)
    first = next((n for n in names if "bank" in n.lower() or "primary" in n.lower()), names[0] if names else None)
    return [(n, n == first, read_statement(spark, os.path.join(path, n))) for n in names]
