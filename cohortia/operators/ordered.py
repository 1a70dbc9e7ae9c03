"""Running totals over an order that no single task could hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.session import cut


def month_of(day: Column | str) -> Column:
    """Number of a day's month: time shards of which an entity has as many as the calendar has months."""
    return (F.year(day) * 12 + F.month(day)).cast("int")


def carried(
    df: DataFrame, by: list[str], shard: Column, order: list[Column], name: str, over: Callable[[Window | None, str], Column], upto: int = -1, backwards: bool = False,
) -> DataFrame:
    """df with `name`: what `over` gives of the group's rows before each row (upto=-1) or up to it (0), without any group in one task.

    A group with a third of all rows is cut into time shards. `over(w)` is a running aggregate over the window w; each shard is read
    on its own, each shard's result over all its rows is one row, and those, at most as many as there are shards, are run
    through once per group. What the row's own shard doesn't give comes from the shards before. `over` must be a max or a last of
    non-missing values: of two results the later one that isn't missing, or the greater, is the whole one.
    """
    placed = df.withColumn("__shard", shard)
    local = Window.partitionBy(*by, "__shard").orderBy(*order)
    own = placed.withColumn("__own", over(local.rowsBetween(Window.unboundedPreceding, upto), "row"))
    whole = placed.groupBy(*by, "__shard").agg(over(None, "shard").alias("__whole"))
    passed = Window.partitionBy(*by).orderBy(F.desc("__shard") if backwards else F.asc("__shard")).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.withColumn("__before", over(passed, "shards")).where("__before IS NOT NULL").drop("__whole")
    joined = own.join(before, [*by, "__shard"], "left")
    return joined.withColumn(name, over(None, "both")).select(*(c for c in df.columns if c != name), name)


def running_last(value: Column, position: Column, backwards: bool = False) -> Callable[[Window | None, str], Column]:
    """For carried(): the last non-missing value in the order of position."""
    pick = F.min_by if backwards else F.max_by

    def over(w: Window | None, step: str) -> Column:
        if step == "row":
            return F.last(value, ignorenulls=True).over(w)
        if step == "shard":
            return pick(value, F.when(value.isNotNull(), position))
        return F.last("__whole", ignorenulls=True).over(w) if step == "shards" else F.coalesce("__own", "__before")

    return over


def running_max(value: Column) -> Callable[[Window | None, str], Column]:
    """For carried(): the greatest value."""
    def over(w: Window | None, step: str) -> Column:
        if step == "row":
            return F.max(value).over(w)
        if step == "shard":
            return F.max(value)
        return F.max("__whole").over(w) if step == "shards" else F.greatest("__own", "__before")

    return over


def running_sums(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column | str], label: str = "orden") -> DataFrame:
    """df with, per entry of sums, the running sum within the group `by` in the given order, the row itself included.

    Rows are sorted by range over all tasks and written once, so that the pieces stay what they are; each piece then adds
    up its own rows and the sums of the pieces before it, which are one row per piece and group. A group with nearly all rows
    is so spread like any other. Rows equal in group and order share a piece and are added up in any order among themselves.
    """
    keys = [*by, *order]
    placed = cut(df.repartitionByRange(*keys).withColumn("__piece", F.spark_partition_id()), label)
    local = Window.partitionBy("__piece", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: (F.col(c) if isinstance(c, str) else c) for k, c in sums.items()}
    pieces = placed.groupBy("__piece", *by).agg(*(F.sum(c).alias(f"__s_{k}") for k, c in names.items()))
    offsets = pieces.select("__piece", *by, *(F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in names))
    same = [F.col("l.__piece") == F.col("o.__piece"), *(F.col(f"l.{b}").eqNullSafe(F.col(f"o.{b}")) for b in by)]
    own = placed.select("*", *(F.sum(c).over(local).alias(f"__l_{k}") for k, c in names.items()))
    joined = own.alias("l").join(offsets.alias("o"), same)
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), *((F.col(f"l.__l_{k}") + F.col(f"o.__s_{k}")).alias(k) for k in names))
