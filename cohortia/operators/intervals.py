"""Continuous periods and gaps from overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, key: str, start: str, end: str, shard_days: int = 366) -> DataFrame:
    """(key, desde, hasta, n): longest runs of covered days and the number of intervals in each.

    start and end are integer days, both included; runs on consecutive days are one run. Two levels:

    1. Intervals are clipped to shards of shard_days days. Within an entity, shard and first day only the
       latest last day matters, so a combined aggregate leaves at most shard_days rows per entity and shard,
       whatever the entity's size; those are merged locally.
    2. The merged pieces of an entity, at most one for every second day, are stitched where one ends on the
       day before the next begins, which also joins pieces cut at a shard boundary.

    An interval counts once, in the shard where it begins. Rows without key, start or end and rows that end
    before they start are left out; repeated rows count as intervals of their own. An empty table gives no rows.
    """
    kept = df.select(key, F.col(start).alias("__a"), F.col(end).alias("__b")).where(
        F.col(key).isNotNull() & (F.col("__a") <= F.col("__b"))
    )
    shard = lambda day: F.floor(F.col(day) / F.lit(shard_days)).cast("int")
    clipped = kept.select(
        key, "__a", "__b", F.explode(F.sequence(shard("__a"), shard("__b"))).alias("__s")
    ).select(
        key,
        "__s",
        F.greatest(F.col("__a"), F.col("__s") * shard_days).alias("__a"),
        F.least(F.col("__b"), F.col("__s") * shard_days + (shard_days - 1)).alias("__b"),
        (F.col("__a") >= F.col("__s") * shard_days).cast("bigint").alias("__n"),
    )
    firsts = clipped.groupBy(key, "__s", "__a").agg(F.max("__b").alias("__b"), F.sum("__n").alias("__n"))
    pieces = _coalesce(firsts, [key, "__s"])
    return _coalesce(pieces, [key]).select(
        key, F.col("__a").alias("desde"), F.col("__b").alias("hasta"), F.col("__n").alias("n")
    )


def _coalesce(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs over (__a, __b, __n) within the keys; at most one row per key and __a is expected, more do no harm."""
    order = Window.partitionBy(*keys).orderBy("__a", "__b")
    before = F.max("__b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("__a") > before + 1), F.col("__a"))
    return (
        df.withColumn("__open", opens)
        .withColumn("__open", F.last("__open", ignorenulls=True).over(order))
        .groupBy(*keys, "__open")
        .agg(F.max("__b").alias("__b"), F.sum("__n").alias("__n"))
        .withColumnRenamed("__open", "__a")
    )


def periods_and_gaps(periods: DataFrame, key: str) -> DataFrame:
    """(key, tipo, desde, hasta, n): the periods as PERIODO and the uncovered runs between them as HUECO (n = 0)."""
    before = F.lag("hasta").over(Window.partitionBy(key).orderBy("desde"))
    both = F.array(
        F.struct(F.lit("PERIODO").alias("tipo"), F.col("desde"), F.col("hasta"), F.col("n")),
        F.struct(F.lit("HUECO").alias("tipo"), (F.col("__prev") + 1).alias("desde"), (F.col("desde") - 1).alias("hasta"), F.lit(0).cast("bigint").alias("n")),
    )
    return periods.withColumn("__prev", before).select(key, F.inline(both)).where(F.col("desde").isNotNull())
