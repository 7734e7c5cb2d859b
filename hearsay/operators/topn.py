"""First rows per group and exact samples, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import salts_of

# Slices of the hash space in a sample: 16 ** HEX_DIGITS of them.
HEX_DIGITS = 5


def first_per_group(
    df: DataFrame,
    group: str,
    order_by: Sequence[Column | str],
    n: int,
    salt_by: Sequence[str],
    salts: int | None = None,
    rank_as: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group, and optionally their rank; ``keep`` names the columns
    that are wanted of them.

    ``order_by`` should be a total order.

    Rows are ranked within salted parts of a group first, and then only the first ``n`` of each
    part within the group. A hot group is thereby shared by ``salts`` tasks, and none receives
    what all scan tasks have kept of it. Tasks drop what cannot be among the first ``n`` before
    they send rows; Spark does so up to a threshold, which is raised here for a larger ``n``.
    """
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    if n > int(df.sparkSession.conf.get(limit)):
        df.sparkSession.conf.set(limit, n)

    def ranked(frame: DataFrame, *keys: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order_by)
        return frame.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n)

    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts or salts_of(df)))
    parts = ranked(df.withColumn("_salt", salt), group, "_salt").drop("_salt", "_rank")
    first = ranked(parts, group)
    if keep is not None:
        first = first.select(*keep, "_rank")
    return first.withColumnRenamed("_rank", rank_as) if rank_as else first.drop("_rank")


def sample_rows(df: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, those with the smallest seeded hash of a unique key.

    The choice does not depend on partitioning. A first pass over the key alone counts rows per
    slice of the hash space, which says in which slice the sample ends. A second pass reads only
    rows up to there and ranks them slice by slice. A plain top-n would send n rows of every scan
    task to a single task.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    drawn = df.withColumn("_digest", digest)
    drawn = drawn.withColumn("_slice", F.left("_digest", F.lit(HEX_DIGITS)))
    # The number of slices is fixed, whatever the number of rows.
    slices = drawn.groupBy("_slice").count()
    up_to = F.sum("count").over(Window.orderBy("_slice"))
    split = slices.select("_slice", up_to.alias("up_to"), "count").where(F.col("up_to") > n)
    before = F.col("up_to") - F.col("count")
    # The first slice that does not fit whole, and the room left for it; null when all rows fit.
    cut = split.agg(F.min(F.struct("_slice", (F.lit(n) - before).alias("room")))).scalar()
    inside = drawn.where(F.coalesce(F.col("_slice") <= cut["_slice"], F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_digest", key))
    ranked = inside.withColumn("_rank", rank)
    kept = (F.col("_slice") < cut["_slice"]) | (F.col("_rank") <= cut["room"])
    return ranked.where(F.coalesce(kept, F.lit(True))).select(*df.columns)
