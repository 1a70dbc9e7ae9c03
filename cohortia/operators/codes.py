"""Code filter: association of sparse codes with an outcome, lists, stability."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortia.functions.text import code_category, read_value

CHI2_P001 = 10.827566  # chi-square with one degree of freedom whose upper tail is 0.001


def code_pairs(df: DataFrame, record_id: str, blocks: dict[str, list[str]], levels: tuple[str, ...] = ("COMPLETO",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (record, block, level, code) of the repeated columns, with the columns in keep.

    Duplicates within a record are removed inside the row (array_distinct), so no shuffle is needed; the record id must
    be unique.
    """
    parts = []
    for block, cols in blocks.items():
        codes = F.array_compact(F.array(*(read_value(c) for c in cols)))
        for level in levels:
            own = F.array_distinct(codes if level == "COMPLETO" else F.transform(codes, code_category))
            parts.append(_named(own, block, level))
    return df.select(F.col(record_id), *keep, F.inline(F.concat(*parts)))


def _named(codes: Column, block: str, level: str) -> Column:
    return F.transform(codes, lambda c: F.struct(F.lit(block).alias("block"), F.lit(level).alias("level"), c.alias("code")))


def association(pairs: DataFrame, cases: DataFrame, record_id: str, outcome: str, by: tuple[str, ...] = ()) -> DataFrame:
    """2x2 table of each code with the outcome among cases that have one, per group in `by`: n cases with the code, c positives,
    rates in percent, chi2 without correction, v (Cramer), relative risk and direction.

    pairs may hold the outcome and `by` already, as from code_pairs(keep=...) over records joined while they were one row each: then
    no pair is shuffled, only combined counts. Totals are a separate small aggregate.
    """
    known = cases.where(F.col(outcome).isNotNull()).select(record_id, *by, F.col(outcome).cast("bigint").alias("__y"))
    totals = known.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum("__y").alias("positives"))
    n = _outcomes(pairs, known, record_id, outcome).groupBy(*by, "block", "level", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("c"))
    if by:
        return with_measures(n.join(totals, list(by)))
    whole = totals.select(F.struct("total", "positives").alias("t")).scalar()
    return with_measures(n.withColumn("t", whole).select("*", "t.total", "t.positives").drop("t"))


def _outcomes(pairs: DataFrame, known: DataFrame, record_id: str, outcome: str) -> DataFrame:
    if outcome in pairs.columns:
        return pairs.where(F.col(outcome).isNotNull()).withColumn("__y", F.col(outcome).cast("bigint"))
    return pairs.join(known, record_id)


def with_measures(counts: DataFrame) -> DataFrame:
    """Rates, chi2, v, risk and direction from n, c, total, positives."""
    n, c, t, p = (F.col(x).cast("double") for x in ("n", "c", "total", "positives"))
    observed = [c, n - c, p - c, t - n - p + c]
    expected = [n * p / t, n * (t - p) / t, (t - n) * p / t, (t - n) * (t - p) / t]
    terms = [F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0) for o, e in zip(observed, expected)]
    chi2 = reduce(lambda a, b: a + b, terms)
    with_code, without = c / F.nullif(n, F.lit(0.0)), (p - c) / F.nullif(t - n, F.lit(0.0))
    return (
        counts.withColumn("rate_with", F.round(100 * with_code, 6)).withColumn("rate_without", F.round(100 * without, 6))
        .withColumn("chi2", F.round(chi2, 6)).withColumn("v", F.round(F.sqrt(chi2 / t), 6))
        .withColumn("risk", F.when((c > 0) & (without > 0), F.round(with_code / without, 6)))
        .withColumn("direction", F.when(with_code > without, "RISK").when(with_code < without, "PROTECTIVE").otherwise("NONE"))
    )


def with_p_value(measured: DataFrame) -> DataFrame:
    """Adds p: upper tail of chi2 with one degree of freedom, erfc(sqrt(chi2 / 2)). Neither engine has erfc, so this is one
    Arrow-batched pass over the table of codes, not over records."""
    from math import erfc, sqrt

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["p"] = [erfc(sqrt(max(x, 0.0) / 2)) for x in f["chi2"]]
            yield f

    return measured.mapInPandas(run, StructType([*measured.schema.fields, StructField("p", DoubleType())]))


def in_list_a(least_n: int = 100, least_v: float = 0.01) -> Column:
    return (F.col("n") >= least_n) & (F.col("v") >= least_v)


def in_list_c(least_n: int = 100, least_v: float = 0.01, risk: float = 2.0) -> Column:
    strong = F.coalesce((F.col("risk") >= risk) | (F.col("risk") <= 1 / risk), F.lit(False)) & (F.col("chi2") > CHI2_P001)
    return (F.col("n") >= least_n) & ((F.col("v") >= least_v) | strong)


def in_grouped_list(least_n: int = 100, least_v: float = 0.01) -> Column:
    """Rule A on diagnosis categories and complete procedures."""
    kind = ((F.col("block") == "DIAGNOSTICO") & (F.col("level") == "CATEGORIA")) | ((F.col("block") == "PROCEDIMIENTO") & (F.col("level") == "COMPLETO"))
    return kind & in_list_a(least_n, least_v)


def per_fold(pairs: DataFrame, cases: DataFrame, record_id: str, outcome: str, fold: str, folds: int) -> DataFrame:
    """Measures of every code leaving out each fold in turn (fold 0: none left out). Every code has a row for every fold, with zeros
    where all its records lie in the fold left out.

    One conditional sum per fold and code; pairs may hold outcome and fold already, see association().
    """
    known = cases.where(F.col(outcome).isNotNull()).select(record_id, fold, F.col(outcome).cast("bigint").alias("__y"))

    def left_out(rows: DataFrame, keys: list[str], n: str, c: str) -> DataFrame:
        stays = {k: F.lit(True) if k == 0 else F.col(fold) != k for k in range(folds + 1)}
        sums = rows.groupBy(*keys).agg(*(x for k, s in stays.items() for x in (F.sum(s.cast("bigint")).alias(f"n{k}"), F.sum(F.when(s, F.col("__y")).otherwise(0)).alias(f"c{k}"))))
        return sums.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("fold"), F.col(f"n{k}").alias(n), F.col(f"c{k}").alias(c)) for k in stays))))

    n = left_out(_outcomes(pairs, known, record_id, outcome), ["block", "level", "code"], "n", "c")
    return with_measures(n.join(F.broadcast(left_out(known, [], "total", "positives")), "fold"))


def threshold_grid(measured: DataFrame, least_n: list[int], least_v: list[float]) -> DataFrame:
    """Codes that pass each pair of thresholds; the grid is an array inside one aggregate's row."""
    cells = [(a, b) for a in least_n for b in least_v]
    sums = measured.agg(*(F.sum(in_list_a(a, b).cast("bigint")).alias(f"k{i}") for i, (a, b) in enumerate(cells)))
    rows = F.array(*(F.struct(F.lit(a).alias("least_n"), F.lit(b).alias("least_v"), F.col(f"k{i}").alias("codes")) for i, (a, b) in enumerate(cells)))
    return sums.select(F.inline(rows))


def list_stability(members: DataFrame, folds: int) -> DataFrame:
    """members (fold, block, level, code), fold 0 the whole list: per fold its Jaccard overlap with the whole list, codes
    entering and leaving; one aggregate over each code's set of folds."""
    held = members.groupBy("block", "level", "code").agg(F.collect_set("fold").alias("fs"))  # at most folds + 1 entries
    whole = F.array_contains("fs", F.lit(0))
    rows = held.select("fs", whole.alias("whole"), F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    own = F.array_contains("fs", F.col("fold"))
    n = lambda c: F.sum(c.cast("bigint"))
    g = rows.groupBy("fold").agg(n(own & F.col("whole")).alias("both"), n(own & ~F.col("whole")).alias("entering"), n(~own & F.col("whole")).alias("leaving"))
    return g.withColumn("jaccard", F.round(F.col("both") / F.nullif(F.col("both") + F.col("entering") + F.col("leaving"), F.lit(0)), 6))


def top_by_direction(measured: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy("direction").orderBy(F.desc("v"), "block", "level", "code")
    return measured.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def prevalence_drift(pairs: DataFrame, year: str, ratio: float = 3.0) -> DataFrame:
    """Codes whose yearly share of all pairs varies by more than ratio, or that are missing in some year."""
    n = pairs.groupBy("block", "level", "code", year).agg(F.count(F.lit(1)).alias("n"))
    totals = n.groupBy("block", "level", year).agg(F.sum("n").alias("t"))
    years = totals.groupBy("block", "level").agg(F.count(F.lit(1)).alias("years"))
    share = n.join(F.broadcast(totals), ["block", "level", year]).withColumn("s", F.col("n") / F.col("t"))
    per = share.groupBy("block", "level", "code").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.lit(1)).alias("seen"))
    out = per.join(F.broadcast(years), ["block", "level"])
    missing = F.col("seen") < F.col("years")
    return out.where(missing | (F.col("hi") > ratio * F.col("lo"))).select("block", "level", "code", F.round(F.col("hi") / F.col("lo"), 6).alias("ratio"), (F.col("years") - F.col("seen")).alias("missing_years"))


def least_rate_for_v(measured: DataFrame, least_v: float = 0.01) -> DataFrame:
    """Rate (percent) a code of n cases must exceed to reach v: overall rate p plus v * sqrt(p (1 - p) (t - n) / n)."""
    p = F.col("positives") / F.col("total")
    need = 100 * (p + F.lit(least_v) * F.sqrt(p * (1 - p) * (F.col("total") - F.col("n")) / F.col("n")))
    return measured.withColumn("least_rate", F.round(need, 6))
