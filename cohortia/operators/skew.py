"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_totals(df: DataFrame, keys: dict[str, Column], **aggs: Column) -> DataFrame:
    """Totals per key by map-side combining.

    Only algebraic aggregates (count, sum, min, max, avg) belong in aggs: each partition keeps one mergeable
    state per key in a bounded hash table, which falls back to sorting and spilling when it is full, and only
    those states are shuffled. A key with a third of all rows so costs each reducer one state per map task.
    A null key is a group of its own; an empty table gives no rows.
    """
    return df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*(c.alias(k) for k, c in aggs.items()))


def key_counts(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(campo, clave, n): how many rows each key of several fields holds, in one scan and one shuffle.

    Keys are strings; a missing value is no key. Rows of a field never cross to another, so equal values of
    two fields stay apart.
    """
    pairs = F.array(*(F.struct(F.lit(name).alias("campo"), c.cast("string").alias("clave")) for name, c in fields.items()))
    return (
        df.select(F.inline(pairs))
        .where(F.col("clave").isNotNull())
        .groupBy("campo", "clave")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def heavy_keys(df: DataFrame, fields: dict[str, Column], per: int = 50) -> DataFrame:
    """(campo, clave, n) of the keys that hold at least one row in `per` of all rows.

    At most `per` keys of a field can qualify, so the result is bounded whatever the input. The total is a
    scalar subquery; the comparison is in whole numbers.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return key_counts(df, fields).where(F.col("n") * per >= total.scalar())


def distinct_per_key(df: DataFrame, keys: list[str], value: str, **aggs: Column) -> DataFrame:
    """Exact number of distinct values per key in two combined steps, with further sums.

    The first step reduces to one state per (key, value), spread over all tasks even where one key is hot;
    the second adds those up, again combined map-side. aggs maps a name to a summable column.
    """
    first = df.groupBy(*keys, value).agg(*(F.sum(c).alias(k) for k, c in aggs.items()), F.count(F.lit(1)).alias("__n"))
    return first.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.count(value).alias("distintos"), *(F.sum(k).alias(k) for k in aggs)
    )


def join_with_hot_keys(left: DataFrame, right: DataFrame, keys: list[str], hot: list, how: str = "left", salts: int = 32) -> DataFrame:
    """Equi-join that spreads the left rows of the listed hot values of keys[0] over `salts` tasks.

    right is replicated only for those values, so its growth is len(hot) * salts rows. The list must be short:
    callers derive it from heavy_keys, which bounds it.
    """
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.coalesce(F.col(keys[0]).isin(*hot), F.lit(False))
    spread = left.withColumn("__salt", F.when(is_hot, F.floor(F.rand(7) * salts).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return spread.join(right.withColumn("__salt", F.explode(copies)), [*keys, "__salt"], how).drop("__salt")


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", broadcast_rows: int = 200_000, size: int | None = None) -> DataFrame:
    """Join in which right is counted first: up to broadcast_rows it is broadcast and left isn't shuffled at all;
    beyond, both are shuffled, with the values of keys[0] that hold at least 1/64 of left's rows salted. size is given
    where the caller knows it, or where a row of right holds a list and the entries count."""
    if (right.count() if size is None else size) <= broadcast_rows:
        return left.join(F.broadcast(right), keys, how)
    kind = left.schema[keys[0]].dataType
    hot = [r["clave"] for r in heavy_keys(left, {keys[0]: F.col(keys[0])}, per=64).collect()]
    return join_with_hot_keys(left, right, keys, [F.lit(h).cast(kind) for h in hot], how)
