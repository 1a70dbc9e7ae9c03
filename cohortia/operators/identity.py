"""Persons behind shared patient identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.skew import sized_join
from cohortia.session import cut


def identity_combinations(df: DataFrame) -> DataFrame:
    """(patient_id, combos, births, sexes, n): distinct values seen under each identifier, in two combined steps. A combination is a
    sex and a birth, either of which may be missing."""
    seen = df.where("patient_id IS NOT NULL").groupBy("patient_id", "sex", "birth").agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("combos"), F.count_distinct("birth").alias("births"), F.count_distinct("sex").alias("sexes"), F.sum("n").alias("n")
    )


def generic_ids(df: DataFrame, generic_min: int = 5) -> DataFrame:
    """Identifiers with at least generic_min distinct (sex, birth) pairs; a missing sex or birth is a value."""
    return identity_combinations(df).where(F.col("combos") >= generic_min).select("patient_id", "combos", "n")


def _linked(a: Column, b: Column, days: int, same_day_month: bool) -> Column:
    near = F.abs(F.datediff(a, b)) <= days
    return near | ((F.month(a) == F.month(b)) & (F.dayofmonth(a) == F.dayofmonth(b))) if same_day_month else near


def birth_persons(df: DataFrame, days: int = 366, same_day_month: bool = True, generic_min: int = 5) -> DataFrame:
    """(patient_id, birth, n): the person number of each distinct birth date of an identifier that isn't generic.

    Two births are one person's if they are at most `days` apart or fall on the same day and month; persons are
    the connected components, numbered from the oldest birth. An identifier that isn't generic has fewer than
    generic_min births, so components settle in generic_min - 2 rounds of taking the least linked label; the
    rounds run over an array inside the row, without any join.
    """
    generic = generic_ids(df, generic_min).select("patient_id")
    births = df.where("patient_id IS NOT NULL AND birth IS NOT NULL").select("patient_id", "birth").distinct()
    listed = births.join(generic, "patient_id", "left_anti").groupBy("patient_id").agg(F.sort_array(F.collect_list("birth")).alias("bs"))
    labelled = listed.withColumn("ls", F.col("bs"))
    for _ in range(max(generic_min - 2, 1)):
        least = lambda b: F.array_min(F.transform(F.filter(F.arrays_zip("bs", "ls"), lambda o: _linked(o["bs"], b, days, same_day_month)), lambda o: o["ls"]))
        labelled = labelled.select("patient_id", "bs", F.transform("bs", least).alias("ls"))
    owners = F.sort_array(F.array_distinct("ls"))
    return labelled.select("patient_id", owners.alias("os"), F.explode(F.arrays_zip("bs", "ls")).alias("z")).select(
        "patient_id", F.col("z.bs").alias("birth"), F.array_position("os", F.col("z.ls")).cast("int").alias("n")
    )


def assign_persons(df: DataFrame, days: int = 366, same_day_month: bool = True, generic_min: int = 5) -> DataFrame:
    """df with person_id = patient_id * 100 + n, null for generic identifiers.

    A row without birth belongs to person 1 if its identifier has one person or no birth at all, else to none. An identifier brings
    one row with its at most generic_min - 1 births; many rows of one identifier are spread by sized_join.
    """
    numbers = birth_persons(df, days, same_day_month, generic_min)
    persons = numbers.groupBy("patient_id").agg(F.max("n").alias("__persons"))
    generic = generic_ids(df, generic_min).select("patient_id", F.lit(True).alias("__generic"))
    known = numbers.groupBy("patient_id").agg(F.map_from_entries(F.collect_list(F.struct("birth", "n"))).alias("__births")).join(persons, "patient_id", "full").join(generic, "patient_id", "full")
    joined = sized_join(df.drop("person_id"), cut(known, "personas"), ["patient_id"]).withColumn("__n", F.col("__births")[F.col("birth")]).drop("__births")
    alone = F.col("birth").isNull() & (F.coalesce("__persons", F.lit(1)) == 1)
    number = F.when(F.col("__generic").isNotNull() | F.col("patient_id").isNull(), None).otherwise(F.coalesce("__n", F.when(alone, 1)))
    return joined.withColumn("person_id", F.col("patient_id") * 100 + number).drop("__n", "__persons", "__generic")


def ambiguous_identity(df: DataFrame, generic_min: int = 5) -> DataFrame:
    """(patient_id, varies, resolved) of identifiers with more than one sex or birth."""
    c = identity_combinations(df).where("births > 1 OR sexes > 1")
    varies = F.when((F.col("births") > 1) & (F.col("sexes") > 1), "BOTH").when(F.col("births") > 1, "BIRTH").otherwise("SEX")
    persons = birth_persons(df, generic_min=generic_min).groupBy("patient_id").agg(F.max("n").alias("p"))
    resolved = F.when(F.col("combos") >= generic_min, "GENERIC").when(F.col("p") > 1, "SEVERAL").otherwise("ONE")
    return c.join(persons, "patient_id", "left").select("patient_id", varies.alias("varies"), resolved.alias("resolved"))


def continuity(df: DataFrame, key: str, year: str) -> DataFrame:
    """(year_a, year_b, ids, same): identifiers that two years share and how many of them keep one sex and birth.

    Rows are reduced to one per identifier and year first; the pairs of years of an identifier come from an array of at
    most as many entries as there are years.
    """
    held = df.where(F.col(key).isNotNull()).groupBy(key, year).agg(
        F.min("sex").alias("s0"), F.max("sex").alias("s1"), F.min("birth").alias("b0"), F.max("birth").alias("b1")
    )
    years = held.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(year).alias("y"), "s0", "s1", "b0", "b1"))).alias("ys"))
    pairs = years.select(F.explode("ys").alias("a"), "ys").select("a", F.explode("ys").alias("b")).where("a.y < b.y")
    steady = (F.col("a.s0").eqNullSafe(F.col("b.s0")) & F.col("a.s1").eqNullSafe(F.col("b.s1")) & F.col("a.s0").eqNullSafe(F.col("a.s1"))
              & F.col("a.b0").eqNullSafe(F.col("b.b0")) & F.col("a.b1").eqNullSafe(F.col("b.b1")) & F.col("a.b0").eqNullSafe(F.col("a.b1")))
    return pairs.groupBy(F.col("a.y").alias("year_a"), F.col("b.y").alias("year_b")).agg(
        F.count(F.lit(1)).alias("ids"), F.sum(steady.cast("bigint")).alias("same")
    )


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent present value of each key, ties to the smaller; combined counts, then max_by over structs."""
    n = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("m")).select(
        key, F.col("m.v").alias(value), (-F.col("m.k")).alias("n")
    )


def sequence_gap(df: DataFrame, key: str, order: str) -> DataFrame:
    """lag and lead of `order` within the key."""
    w = Window.partitionBy(key).orderBy(order, "encounter_id")
    return df.withColumn("previous", F.lag(order).over(w)).withColumn("following", F.lead(order).over(w))
