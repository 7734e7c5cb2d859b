"""Row features, label codes and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import TEXT_STATS, text_statistics, time_features
from ..functions.text import once
from .filters import coerce_dates
from .joins import lookup_join
from .quantiles import exact_quantiles
from .scratch import cut_lineage


def add_text_features(df: DataFrame, text_column: str = "text_cleaned") -> DataFrame:
    """Nine ``text_*`` columns."""
    if text_column not in df.columns:
        return df
    names = [f"text_{name}" for name in TEXT_STATS]
    return df.select("*", once(text_statistics(text_column)).alias(*names))


def add_time_features(
    df: DataFrame, date_column: str = "date", formats: Sequence[str] = ()
) -> DataFrame:
    if date_column not in df.columns:
        return df
    return coerce_dates(df, date_column, formats).withColumns(time_features(date_column))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: codes 0..n-1 in sorted order of the distinct values.

    The values are sorted across the cluster. A code is the position inside a sorted partition plus
    the number of values in the partitions before it, so no task sees all values. The sorted values
    are checkpointed because both parts must be read from the same partitioning.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")
    placed = df.select(value).distinct().orderBy("value")
    # The low 33 bits of the generated id count rows within a partition.
    row_id = F.monotonically_increasing_id()
    placed = placed.select(
        "value",
        F.spark_partition_id().alias("part"),
        row_id.bitwiseAND(F.lit((1 << 33) - 1)).alias("position"),
    )
    placed = cut_lineage(placed)
    # One row per partition, so this table is as small as the list of partitions.
    sizes = placed.groupBy("part").count()
    before = F.sum("count").over(Window.orderBy("part")) - F.col("count")
    starts = F.broadcast(sizes.select("part", before.alias("before")))
    code = (F.col("before") + F.col("position")).cast("bigint")
    return placed.join(starts, "part").select("value", code.alias("code"))


def encode_labels(
    df: DataFrame, columns: Sequence[str], salt_by: Sequence[str] = ("post_id",)
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``<column>_encoded`` columns, and the code table of each; missing columns are skipped."""
    encoded, tables = df, {}
    for column in columns:
        if column not in df.columns:
            continue
        tables[column] = label_codes(df, column)
        encoded = apply_label_codes(encoded, {column: tables[column]}, salt_by=salt_by)
    return encoded, tables


def apply_label_codes(
    df: DataFrame,
    tables: Mapping[str, DataFrame],
    unseen: int | None = None,
    salt_by: Sequence[str] = ("post_id",),
) -> DataFrame:
    """``<column>_encoded`` columns from the code tables of ``encode_labels``, for other rows.

    Values that the tables do not have get ``unseen`` (null, unless a number is given). The codes of
    known values never change, whatever else the new rows hold. Missing columns are skipped.
    """
    encoded = df
    for column, codes in tables.items():
        if column not in df.columns:
            continue
        key, output = f"_{column}_value", f"{column}_encoded"
        table = codes.select(F.col("value").alias(key), F.col("code").alias(output))
        value = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
        encoded = lookup_join(encoded.withColumn(key, value), table, key, salt_by).drop(key)
        if unseen is not None:
            encoded = encoded.withColumn(
                output, F.coalesce(output, F.lit(unseen).cast("bigint"))
            )
    return encoded


def decode_labels(
    df: DataFrame, tables: Mapping[str, DataFrame], salt_by: Sequence[str] = ("post_id",)
) -> DataFrame:
    """``<column>_decoded`` columns: the values, as text, of codes in ``<column>_encoded``; null for
    a code that no value has."""
    decoded = df
    for column, codes in tables.items():
        key = f"{column}_encoded"
        if key in df.columns:
            table = codes.select(
                F.col("code").alias(key), F.col("value").alias(f"{column}_decoded")
            )
            decoded = lookup_join(decoded, table, key, salt_by)
    return decoded


@dataclass(frozen=True)
class Scaler:
    """Centre and width per column; scaling is one projection."""

    method: str
    centers: Mapping[str, float | None]
    widths: Mapping[str, float | None]

    def transform(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        scaled = {}
        for c, center in self.centers.items():
            width = self.widths[c] or 1.0
            scaled[f"{c}{suffix}"] = (F.col(c).cast("double") - F.lit(center)) / F.lit(width)
        return df.withColumns(scaled)


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard") -> Scaler:
    """Population mean and deviation, minimum and range, or median and interquartile range.

    A column of one repeated value has width 0 and is only centred.
    """
    if method == "robust":
        rows = exact_quantiles(df, {c: c for c in columns}, (0.25, 0.5, 0.75)).collect()
        found = {(r["metric"], r["prob"]): r["value"] for r in rows}
        centers = {c: found.get((c, 0.5)) for c in columns}
        widths = {
            c: found[c, 0.75] - found[c, 0.25] if (c, 0.5) in found else None for c in columns
        }
        return Scaler(method, centers, widths)
    # NaN is no number to fit on, as in the quantiles.
    used = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    if method == "standard":
        parts = {c: (F.avg(v), F.stddev_pop(v)) for c, v in used.items()}
    elif method == "minmax":
        parts = {c: (F.min(v), F.max(v) - F.min(v)) for c, v in used.items()}
    else:
        raise ValueError(f"no such scaling: {method!r} (standard, minmax or robust)")
    row = df.agg(
        *[part.cast("double").alias(f"{c}:{i}") for c, ps in parts.items() for i, part in enumerate(ps)]
    ).first()
    return Scaler(method, {c: row[f"{c}:0"] for c in columns}, {c: row[f"{c}:1"] for c in columns})
