"""CSV, JSON and Parquet tables of posts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import to_datetime
from ..schema import POST, REQUIRED_COLUMNS

# One quoted file with embedded line breaks is read by one task, so files are kept to this many rows.
CSV_ROWS_PER_FILE = 250_000


def write_by_day(df: DataFrame, path: str, date_column: str = "date", day_column: str = "day") -> None:
    """Parquet in one folder per day, so that a date filter reads only its days.

    Rows stay in the tasks they are in: no shuffle, and a hot day is written by many tasks.
    """
    parsed = to_datetime(date_column, df.schema[date_column].dataType)
    dated = df.withColumn(date_column, parsed).withColumn(day_column, parsed.cast("date"))
    dated.write.mode("overwrite").partitionBy(day_column).parquet(path)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = POST,
    required: Sequence[str] = REQUIRED_COLUMNS,
    multi_line: bool = True,
) -> DataFrame:
    """Quoted CSV with a header, read by column name; empty fields are null.

    Columns of ``schema`` take its types, in its order, and are null where the file lacks them; other
    columns follow as text. A missing ``required`` column is an error, and so is a file whose header
    differs from the first one's. ``multi_line`` lets quoted fields hold line breaks, but then a file
    is read by one task: turn it off for large files known to have none.
    """
    table = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("lineSep", "\n")
        .option("nullValue", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )
    missing = [c for c in required if c not in table.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    known = [
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in table.columns
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema
    ]
    others = [F.col(f"`{c}`") for c in table.columns if c not in schema.fieldNames()]
    return table.select(*known, *others)


def write_csv(df: DataFrame, path: str, rows_per_file: int = CSV_ROWS_PER_FILE) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("lineSep", "\n")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def read_json(
    spark: SparkSession, path: str, schema: T.StructType = POST, mode: str = "FAILFAST"
) -> DataFrame:
    """One JSON object per line. A line that is none fails the read; ``mode="PERMISSIVE"`` reads it
    as nulls and ``"DROPMALFORMED"`` leaves it out."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written out, so that the files stay splittable."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_or_create(
    spark: SparkSession,
    path: str,
    create: Callable[[], DataFrame] | None = None,
    schema: T.StructType = POST,
) -> DataFrame:
    """Read the CSV table at ``path``; when it is missing or empty, build and save it.

    Without ``create`` a missing table reads as an empty one.
    """
    try:
        table = read_csv(spark, path, schema)
        if not table.isEmpty():
            return table
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    if create is None:
        return spark.createDataFrame([], schema)
    write_csv(create(), path)
    return read_csv(spark, path, schema)
