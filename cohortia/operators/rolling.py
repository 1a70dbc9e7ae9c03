"""Totals over trailing periods per entity and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.session import cut

EXACT = ("tinyint", "smallint", "int", "bigint")


def rolling_totals(
    events: DataFrame,
    key: str,
    day: str,
    measures: list[str],
    windows: tuple[int, ...] = (7, 30),
    end_day: int | None = None,
    floor: tuple[str, int] | None = None,
    whole: bool = False,
) -> DataFrame:
    """One row per entity and calendar day with activity in the longest window, with <measure>_<n> totals.

    `day` is an integer day number. Events are first summed to sparse daily totals; each day with activity then
    brings the calendar rows of the inactive days that follow it, up to the next active day, the end of the
    longest window or end_day. On every other day all totals are 0; with whole=True such days, from the entity's first active day
    to end_day, come out too. They cost a row each, but no window is computed over them.
    Windows are RANGE frames over the day number: [day - n + 1, day], for whole-number measures as the difference of the
    frames up to day and up to day - n. Averages have the fixed denominator n.

    floor=(measure, least) is the pushed-down filter `<measure>_<longest window> >= least`: totals of measures
    that aren't negative only fall on inactive days, so an active day below it needs no calendar rows. Rows
    below the floor are dropped.

    A hot entity is cut to one row per day before it reaches a task. Events without key or day are left out, a
    missing measure counts 0, and an empty table gives no rows.
    """
    if whole and (end_day is None or floor):
        raise ValueError("the whole calendar needs an end_day and no floor")
    longest = max(windows)
    sums = [F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in measures]
    kept = events.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    if end_day is not None:
        kept = kept.where(F.col(day) <= end_day)
    daily = kept.groupBy(key, day).agg(*sums)
    if floor is None:
        # A day brings up to `longest` rows: tasks are cut for what comes out, not for the small sparse table.
        daily = daily.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)

    if whole:
        daily = cut(daily, "dias")
    by_day = Window.partitionBy(key).orderBy(day)
    last = F.least(F.lead(day).over(by_day) - 1, F.col(day) + (longest - 1), F.lit(end_day))
    if floor is not None:
        enough = F.sum(floor[0]).over(by_day.rangeBetween(-(longest - 1), 0)) >= floor[1]
        last = F.when(enough, last).otherwise(F.col(day))
    ended = daily.withColumn("__last", last)
    if whole:
        until = F.coalesce(F.lead(day).over(by_day) - 1, F.lit(end_day))
        spread_ends = ended.withColumn("__until", until).where("__until > __last")
    spread = ended.withColumn("__day", F.explode(F.sequence(F.col(day), F.col("__last"))))
    rows = spread.select(
        key,
        F.col("__day").alias(day),
        *(F.when(F.col("__day") == F.col(day), F.col(m)).otherwise(0).alias(m) for m in measures),
    )
    upto = Window.partitionBy(key).orderBy(day)
    types = dict(rows.dtypes)

    def trailing(m: str, n: int) -> Column:
        if types[m] in EXACT:
            # Sliding frames are added up anew for every row; the difference of two growing frames is one pass.
            growing = lambda last: F.coalesce(F.sum(m).over(upto.rangeBetween(Window.unboundedPreceding, last)), F.lit(0))
            return growing(0) - growing(-n)
        return F.sum(m).over(upto.rangeBetween(-(n - 1), 0))

    totals = rows.select(key, day, *(trailing(m, n).alias(f"{m}_{n}") for m in measures for n in windows))
    if whole:
        gaps = spread_ends.select(key, F.explode(F.sequence(F.col("__last") + 1, "__until")).alias(day))
        totals = totals.unionByName(gaps.select(key, day, *(F.lit(0).cast(totals.schema[c].dataType).alias(c) for c in totals.columns[2:])))
    return totals.where(F.col(f"{floor[0]}_{longest}") >= floor[1]) if floor else totals


def with_averages(totals: DataFrame, measures: list[str], windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Adds <measure>_<n>_media: the total over n days divided by n, active or not."""
    return totals.withColumns({f"{m}_{n}_media": F.col(f"{m}_{n}") / F.lit(float(n)) for m in measures for n in windows})
