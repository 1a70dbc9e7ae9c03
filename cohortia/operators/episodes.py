"""Care episodes: contiguous or overlapping stays of a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.ordered import carried, month_of, running_last, running_max

ORDER = ["admit", "discharge", "encounter_id"]
TRANSFER = "DERIVACI"
OTHER_SITE = "OTROS HOSPITALES"


def usable_stay() -> Column:
    return F.col("person_id").isNotNull() & (F.col("discharge") >= F.col("admit"))


def with_leader(df: DataFrame) -> DataFrame:
    """Adds `leader`: of the person's earlier rows by (admit, discharge, id) the one with the latest discharge."""
    row = F.struct("discharge", "admit", "encounter_id", "site", "discharge_type")
    return carried(df.where(usable_stay()), ["person_id"], month_of("admit"), ORDER, "leader", running_max(row))


def transfer_mark() -> Column:
    return F.coalesce(F.col("leader.discharge_type").startswith(TRANSFER), F.lit(False)) | F.coalesce(F.col("origin").startswith(OTHER_SITE), F.lit(False))


def continues(max_days: int = 1, require_mark: bool = False) -> Column:
    """Whether the row goes on with its leader's episode: it begins before the leader's discharge; or within
    max_days of it at another site; or it repeats the leader's one-day stay at the same site."""
    days = F.datediff("admit", "leader.discharge")
    other = ~F.col("site").eqNullSafe(F.col("leader.site"))
    joined = days.between(0, max_days) & other
    if require_mark:
        joined = joined & transfer_mark()
    repeat = (days == 0) & ~other & (F.col("admit") == F.col("leader.admit")) & (F.col("discharge") == F.col("leader.discharge"))
    return F.coalesce((days < 0) | joined | repeat, F.lit(False))


def build_episodes(df: DataFrame, max_days: int = 1, require_mark: bool = False) -> DataFrame:
    """df's usable stays with episode_id (id of the opening row), episode_size, continues, final.

    A person's rows are read month by month, so that a person with many is spread (see carried()); sizes and last rows are
    combined aggregates joined back. Rows without a person or with dates out of order have no episode and are left out. Equal
    rows are told apart by id.
    """
    opened = with_leader(df.drop("episode_id")).withColumn("continues", continues(max_days, require_mark))
    opener = running_last(F.when(~F.col("continues"), F.col("encounter_id")), F.struct("admit", "discharge", "encounter_id"))
    named = carried(opened, ["person_id"], month_of("admit"), ORDER, "episode_id", opener, upto=0)
    last = F.max(F.struct("discharge", "admit", "encounter_id"))
    whole = named.groupBy("episode_id").agg(F.count(F.lit(1)).cast("int").alias("episode_size"), last["encounter_id"].alias("__last"))
    return named.join(whole, "episode_id").withColumn("final", F.col("__last") == F.col("encounter_id")).drop("__last")


def transfer_concordance(episodes: DataFrame) -> DataFrame:
    """Per band of days since the leader's discharge: rows, with a transfer mark, joined, joined with a mark."""
    days = F.datediff("admit", "leader.discharge")
    band = F.when(days < 0, "<0").when(days == 0, "0").when(days == 1, "1").when(days == 2, "2").when(days == 3, "3").when(days <= 7, "4-7").when(days <= 30, "8-30")
    n = lambda c: F.sum(c.cast("bigint"))
    return (
        episodes.where("leader IS NOT NULL").withColumn("band", band).where("band IS NOT NULL").withColumn("mark", transfer_mark())
        .groupBy("band").agg(F.count(F.lit(1)).alias("rows"), n(F.col("mark")).alias("marked"), n(F.col("continues")).alias("joined"), n(F.col("mark") & F.col("continues")).alias("joined_marked"))
    )


def episode_attributes(episodes: DataFrame, critical: str) -> DataFrame:
    """One row per episode: first admission, last discharge, sites, whether any diagnosis matches `critical`, how it
    was opened, the last known discharge type."""
    opening = F.col("encounter_id") == F.col("episode_id")
    return episodes.groupBy("person_id", "episode_id").agg(
        F.min("admit").alias("begin"), F.max("discharge").alias("end"), F.count_distinct("site").alias("sites"),
        F.max(F.coalesce(F.col("dx").rlike(critical), F.lit(False)).cast("int")).alias("critical"),
        F.max(F.when(opening, F.col("admit_type"))).alias("opened_as"),
        F.max_by("discharge_type", F.when(F.col("discharge_type").isNotNull(), F.struct("discharge", "admit", "encounter_id"))).alias("last_type"),
    )
