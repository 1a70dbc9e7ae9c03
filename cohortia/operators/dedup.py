"""Repeated records: flags, the record to keep, incoherent dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_copies(df: DataFrame, data_cols: list[str], file_col: str, order_col: str) -> DataFrame:
    """Adds dup_exact: equal in all data columns (nulls equal) to an earlier row of the same file.

    A combined aggregate keeps the first row of each distinct content, so a record copied a million times is one
    state; the flag is joined back on file and row number.
    """
    firsts = df.groupBy(file_col, *data_cols).agg(F.min(order_col).alias(order_col)).select(file_col, order_col).withColumn("__first", F.lit(True))
    return df.join(firsts, [file_col, order_col], "left").withColumn("dup_exact", F.col("__first").isNull()).drop("__first")


def key_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds dup_key: another row has the same keys, all of them present."""
    present = _all_present(keys)
    repeated = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return df.join(repeated, keys, "left").withColumn("dup_key", F.col("__n").isNotNull()).drop("__n")


def keep_most_complete(df: DataFrame, keys: list[str], loose_keys: list[str], record_id: str, order: list[tuple[str, bool]]) -> DataFrame:
    """The rows to keep: of each group with equal keys (all present) and loose keys (missing equals missing), the best by
    `order`, (column, nullable) pairs, greatest first and missing last, then the smallest id. Rows without a full
    key are always kept.

    The best row of a group is a min over structs, an algebraic aggregate that combines map-side, so a group with a
    third of all rows is one state per task.
    """
    present = _all_present(keys)
    rank = F.struct(*(x for c, _ in order for x in (F.col(c).isNull(), -F.col(c))), F.col(record_id))
    best = df.where(present).groupBy(*keys, *loose_keys).agg(F.min_by(record_id, rank).alias(record_id)).select(record_id)
    keyed = df.where(present).join(best, record_id, "left_semi")
    return keyed.unionByName(df.where(~present))


def _all_present(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def incoherent_dates(df: DataFrame, file_year: str, admit: str, discharge: str, birth: str) -> DataFrame:
    """Counts per file year of eight kinds of missing or impossible dates."""
    a, z, b, y = F.col(admit), F.col(discharge), F.col(birth), F.col(file_year)
    kinds = {
        "no_admit": a.isNull(), "no_discharge": z.isNull(), "no_birth": b.isNull(), "discharge_before_admit": z < a,
        "birth_after_admit": b > a, "older_than_110": F.datediff(a, b) > 110 * 365.25,
        "discharge_outside_year": F.year(z) != y, "admit_before_last_year": F.year(a) < y - 1,
    }
    return df.groupBy(file_year).agg(*(F.sum(F.coalesce(k, F.lit(False)).cast("bigint")).alias(n) for n, k in kinds.items()))


def control_windows(df: DataFrame, keys: list[str]) -> DataFrame:
    """(size, groups, rows): how many key groups have each number of rows; rows without a full key aren't counted."""
    sizes = df.where(_all_present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("rows"))


