"""Development/test split and folds by patient identifier, stratified and reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.draws import draw
from cohortia.operators.ordered import running_sums
from cohortia.operators.skew import sized_join
from cohortia.session import cut


def patient_strata(cases: DataFrame, labels: list[str]) -> DataFrame:
    """(patient_id, block, cases, positives, stratum) per identifier: the block and, for each label, whether any case is
    positive; identifiers without cases are given by the caller through rows with null labels."""
    flags = [F.coalesce(F.max(c), F.lit(0)).cast("string") for c in labels]
    pattern = F.concat(*flags)
    g = cases.where("patient_id IS NOT NULL").groupBy("patient_id", "block").agg(
        F.count(labels[0]).alias("cases"), F.coalesce(F.sum(labels[0]), F.lit(0)).cast("bigint").alias("positives"), pattern.alias("pattern")
    )
    return g.withColumn("stratum", F.concat_ws("-", "block", F.when(F.col("cases") > 0, F.col("pattern")).otherwise("NONE")))


def systematic_deal(units: DataFrame, stratum: str, order: list[str], unit: str, parts: int, seed: int, purpose: str) -> DataFrame:
    """Adds part in 1..parts: within each stratum units are sorted by `order` and a draw and dealt in turn from a drawn start.

    A stratum may hold nearly all units, so no stratum is sorted in one task: places come from running sums over a sort by
    range.
    """
    keyed = units.withColumn("__u", draw(seed, purpose, F.col(unit)))
    placed = running_sums(keyed, [stratum], [*order, "__u", unit], {"__row": F.lit(1)}, "reparto")
    start = F.pmod(draw(seed, f"{purpose}-start", F.col(stratum)), F.lit(parts))
    return placed.withColumn("part", (F.pmod(F.col("__row") - 1 + start, F.lit(parts)) + 1).cast("int")).drop("__u", "__row")


def split_patients(strata: DataFrame, parts: int = 5, seed: int = 20_250) -> DataFrame:
    """(patient_id, block, stratum, subset): one part in `parts` is PRUEBA."""
    dealt = systematic_deal(strata, "stratum", ["positives", "cases"], "patient_id", parts, seed, "split")
    return dealt.withColumn("subset", F.when(F.col("part") == parts, "PRUEBA").otherwise("DESARROLLO"))


def temporal_groups(cases: DataFrame, first_evaluation: int = 2023, known: DataFrame | None = None) -> DataFrame:
    """Adds period (TRAIN, EVALUATE) and seen: for evaluation cases whether the identifier has a row of `known` (by default a case)
    in a training year of the same block; null for training cases. The seen identifiers are joined as distinct keys by checked
    size."""
    period = F.when(F.col("year") < first_evaluation, "TRAIN").otherwise("EVALUATE")
    held = (cases if known is None else known).where((F.col("year") < first_evaluation) & F.col("patient_id").isNotNull())
    seen = cut(held.select("patient_id", "block").distinct().withColumn("__seen", F.lit(1)), "vistos")
    joined = sized_join(cases.withColumn("period", period), seen, ["patient_id", "block"])
    return joined.withColumn("seen", F.when(F.col("period") == "EVALUATE", F.coalesce("__seen", F.lit(0)))).drop("__seen")


def balance(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(column, value, subset, n, share): composition of each subset."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("SIN DATO")).alias("value")) for c in columns))
    n = df.select(by, F.inline(pairs)).groupBy("column", "value", by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("column", by)), 6))


def within_tolerance(shares: DataFrame, by: str, points: float = 0.005, parts: int = 2) -> DataFrame:
    """balance() with within: 1 where all subsets hold the value and their shares differ by at most `points`."""
    w = Window.partitionBy("column", "value")
    ok = (F.max("share").over(w) - F.min("share").over(w) <= points) & (F.count(by).over(w) == parts)
    return shares.withColumn("within", ok.cast("int"))


def straddling_share(units: DataFrame, size: str, parts: int = 5) -> Column:
    """Expected share of cases whose unit would straddle folds if rows were dealt singly: mean of 1 - (1/k)**(m - 1)."""
    return F.sum(F.col(size) * (1 - F.pow(F.lit(1.0 / parts), F.col(size) - 1))) / F.sum(size)


def registered_check(table: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """(both, only_table, only_registered): whether a registered split covers exactly the table's keys, repeated keys once."""
    a = table.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__a", F.lit(1))
    b = registered.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__b", F.lit(1))
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    left, right = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return a.join(b, key, "full").agg(n(left & right).alias("both"), n(left & ~right).alias("only_table"), n(~left & right).alias("only_registered"))
