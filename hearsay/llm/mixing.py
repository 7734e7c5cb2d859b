"""Mixing sources to target weights by nested hash thresholds.

Every row has a hash; a source's budget is met by taking its rows whose hash is below a threshold.
Thresholds are found from histograms of sizes by source and leading hash bits: the bucket in which
the budget falls is split again by the next bits, and only its rows are looked at. Rows are never
sorted, and a smaller budget always takes a subset of a larger one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.operators.joins import lookup_join
from hearsay.operators.scratch import store

from .common import FILE, ROW, running_sums, utf8, with_row_id

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
HASH_BITS = 60
LEVEL_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; null counts 0."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_hash(key: str, text: str) -> Column:
    """60 bits of the MD5 of the key and the text's MD5, which other engines find as well."""
    parts = F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(utf8(text))
    joined = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast(
        "bigint"
    )


def source_key(source: str | Column) -> Column:
    """Text that tells all sources apart, null too."""
    column = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("null"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: the total of all sizes shared
    by weight, no source above ``most`` times its size.

    Sources stand in order of code points, null last, and take the weights in turn. What a source
    cannot take is shared among the others by weight until none is above its limit: sources reach
    it in the order of size over weight, so each needs only the sums of those before it.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    listed = running_sums(sizes, by_name, {"place": F.lit(1).cast("bigint")})
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = listed.withColumn("weight", turn.cast("bigint"))
    limit = F.col("source_size") * most
    filled = running_sums(
        weighed,
        [F.col("source_size") / F.col("weight"), *by_name],
        {"used": limit, "shared": F.col("weight")},
    )
    whole = weighed.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    total, shares = whole["n"] or 0, whole["w"] or 0
    over = (F.lit(total) - F.col("used")) * F.col("weight") > limit * (F.lit(shares) - F.col("shared"))
    marked = store(filled.withColumn("over", over), "filled")
    full = marked.where("over").agg(F.sum(limit).alias("n"), F.sum("weight").alias("w")).first()
    left, share = total - (full["n"] or 0), shares - (full["w"] or 0)
    even = F.lit(left) * F.col("weight") / F.nullif(F.lit(share), F.lit(0))
    return marked.select(
        "source",
        "source_size",
        F.when(F.col("over"), limit.cast("double")).otherwise(even).alias("target"),
    )


def _thresholds(rows: DataFrame, rests: DataFrame) -> DataFrame:
    """``k, below`` for ``rests (k, rest)``: the hash below which a source's rows are taken once more.

    Walks down the levels of the histogram; at each, only rows in the one bucket that holds the
    rest are summed. What is open at the end is one hash value: it is taken if that is nearer.
    """
    zero = F.lit(0).cast("bigint")
    state = store(rests.select("k", zero.alias("prefix"), "rest"), "level")
    parts = []
    for level in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        shift = HASH_BITS - level
        before = Window.partitionBy("k").orderBy("bucket")
        inside = lookup_join(rows.select("k", "h", "size"), state, "k", ["h"], "inner").where(
            F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")
        )
        # At most 2 ** LEVEL_BITS buckets a source.
        met = store(
            inside.groupBy("k", "rest", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("size"))
            .withColumn("upto", F.sum("size").over(before))
            .where("upto > rest and upto - size <= rest")
            .select("k", "bucket", "size", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest")),
            "level",
        )
        # Float dust: where no bucket exceeds the rest, all fits.
        end = F.shiftleft(F.col("prefix") + 1, shift + LEVEL_BITS)
        parts.append(state.join(met.select("k"), "k", "left_anti").select("k", end.alias("below")))
        if shift == 0:
            more = (F.col("rest") > F.col("size") - F.col("rest")).cast("bigint")
            parts.append(met.select("k", (F.col("bucket") + more).alias("below")))
        state = met.select("k", F.col("bucket").alias("prefix"), "rest")
    return reduce(DataFrame.union, parts)


def mix(rows: DataFrame, weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to stored rows with ``source``, ``size``, ``h``.

    Each row is taken ``target // source_size`` times, and once more where its hash is below its
    source's threshold, so never more than ``most`` times. The words taken of a source differ from
    its target by less than the size of one hash value's rows. An empty table gives no rows; sources
    without words have target 0 and their rows 0 copies. There may be any number of sources: their
    table stays distributed, and meets the rows by a join that spreads a large source.
    """
    keyed = rows.withColumn("k", source_key("source"))
    sizes = store(
        rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), "sources"
    )
    size, target = F.col("source_size"), F.col("target")
    budgets = targets(sizes, weights, most).withColumn("k", source_key("source"))
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("bigint")
    rest = target - whole * size
    budgets = store(budgets.withColumns({"whole": whole, "rest": rest}), "budgets")
    below = _thresholds(keyed, budgets.where("source_size > 0 and rest > 0").select("k", "rest"))
    table = store(
        budgets.join(below, "k", "left").select(
            "k", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")
        ),
        "thresholds",
    )
    joined = lookup_join(keyed, table, "k", ["h"], "inner")
    copies = F.col("whole") + (F.col("h") < F.col("below")).cast("bigint")
    return joined.select(*rows.columns, "source_size", "target", copies.alias("copies"))


def mix_documents(
    docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source"
) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; columns stay.

    Rows with equal key and text share a hash, so they are taken or left together.
    """
    known = with_row_id(docs)
    sized = store(
        known.select(
            F.col(source).alias("source"),
            word_count(text).alias("size"),
            row_hash(key, text).alias("h"),
            FILE,
            ROW,
        ),
        "sizes",
    )
    # Of the source's columns only the identity is used, so any other name may occur there.
    taken = (
        mix(sized)
        .where("copies > 0")
        .select(FILE, ROW, F.sequence(F.lit(1).cast("bigint"), F.col("copies")).alias("_llm_n"))
    )
    return (
        known.join(taken, [FILE, ROW])
        .withColumn("_llm_n", F.explode("_llm_n"))
        .select(*docs.columns)
    )
