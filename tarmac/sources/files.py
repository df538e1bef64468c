"""File sources and sinks (S1-S4): schedules as CSV/parquet, sheets, results, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SHEET_SCHEMA = (
    "s_no string, flight_number string, date string, `from` string, `to` string, aircraft string, flight_time string, "
    "std string, atd string, sta string, ata_status string, ata string, line long"
)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# S1
def read_schedule(spark: SparkSession, paths: Sequence[str], schema: str | None = None, fmt: str = "csv") -> DataFrame:
    """Read the first candidate path that exists (CSV with header, or parquet). A schema is
    given explicitly in production; without one CSV columns stay strings (no inference pass)."""
    for p in paths:
        if _exists(spark, p):
            r = spark.read.format(fmt)
            if fmt == "csv":
                r = r.option("header", True)
            if schema:
                r = r.schema(schema)
            return r.load(p)
    raise FileNotFoundError(f"none of the schedule paths exist: {list(paths)}")


# S2
def union_sheets(spark: SparkSession, sheet_dirs: Sequence[str], schema: str = RAW_SHEET_SCHEMA) -> DataFrame:
    """One directory per sheet; the directory name is the sheet / time-slot name. Sheets are read
    in one scan and tagged from the file path metadata; columns missing in a sheet are null."""
    # header names are checked against the schema (a sheet with reordered columns fails loudly)
    df = (spark.read.option("header", True).option("enforceSchema", False)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .schema(schema).csv(list(sheet_dirs)))
    sheet = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    decoded = F.url_decode(sheet)
    return df.withColumns({"file": decoded, "time_slot": decoded})


# S3
def write_schedule(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("date",),
                   mode: str = "overwrite") -> None:
    """Write a result table partitioned by service date (date filters then prune partitions)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    cols = [c for c in partition_by if c in df.columns]
    if cols:
        w = w.partitionBy(*cols)
    w.save(path)
