"""Re-admission labels of index cases under right censoring."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.ordered import carried, month_of, running_last


@dataclass(frozen=True)
class LabelRules:
    windows: tuple[int, ...] = (7, 30)
    margin: int = 30
    unplanned: tuple[str, ...] | None = ("URGENCIA", "OBSTETRICA")  # None: every admission counts
    not_grd: tuple[str, ...] = ("146", "147")
    not_dx: tuple[str, ...] = ("Z51",)
    never_related: tuple[str, ...] = ("99",)
    no_related: tuple[str, ...] = ("14",)  # MDCs whose cases have no related label, where only unplanned admissions count
    mdc_groups: tuple[tuple[str, ...], ...] = ()  # MDCs compared as one
    block_end: tuple[tuple[str, str], ...] = (("A", "2020-12-31"), ("B", "2024-12-31"))

    def all_forms(self) -> LabelRules:
        return replace(self, unplanned=None)


def starts_with_any(c: str, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(F.col(c).startswith(p), F.lit(False))
    return out


def counts_as_readmission(rules: LabelRules) -> Column:
    if rules.unplanned is None:
        return F.lit(True)
    kind = F.coalesce(F.col("admit_type").isin(*rules.unplanned), F.lit(False))
    return kind & ~starts_with_any("grd", rules.not_grd) & ~starts_with_any("dx", rules.not_dx)


def block_end(rules: LabelRules) -> Column:
    out = F.lit(None).cast("date")
    for b, day in rules.block_end:
        out = F.when(F.col("block") == b, F.lit(day).cast("date")).otherwise(out)
    return out


def comparable_mdc(c: Column, rules: LabelRules) -> Column:
    """The MDC by which case and admission are compared: the first of its group; null where it relates to none."""
    out = c
    for group in rules.mdc_groups:
        out = F.when(c.isin(*group), group[0]).otherwise(out)
    return F.when(~c.isin(*rules.never_related), out)


def label_readmissions(df: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """One row per case: readmit_<d>d, readmit_<d>d_mdc (null where not observable), days_to_next and next_id of the first
    counting admission at any distance.

    df has persons, episodes and the booleans is_case and may_readmit of apply_rules(). Candidates are later openings of the same
    person that may be re-admissions, in the order (admit, discharge, id) from the opening of the case's own episode on. The
    first counting one decides readmit_<d>d, the first counting one with the case's MDC decides readmit_<d>d_mdc, as later
    ones are only further away. Both are found in one pass each: openings and cases are laid in one sequence per
    person (and MDC), read backwards so that the frame is a running one, month by month; no case is ever joined with the
    openings of its person, and a person with a third of all rows is spread over the months.

    Labels are null when the case is discharged less than d + margin days before its block ends, *_mdc labels also where the MDC is
    in no_related (not if all admissions count or the MDC is grouped). A case without MDC or with one in never_related has the
    *_mdc label 0.
    """
    rows = df.where("person_id IS NOT NULL AND episode_id IS NOT NULL AND admit IS NOT NULL AND discharge IS NOT NULL").withColumn("__mdc", comparable_mdc(F.col("mdc"), rules))
    # Reference point of an episode: its opening row, or its first row where the opening is not in the table.
    pos = F.struct("admit", "discharge", "encounter_id")
    opening = F.col("encounter_id") == F.col("episode_id")
    seat = F.struct("admit", "discharge", "encounter_id", "__mdc", (counts_as_readmission(rules) & F.coalesce("may_readmit", F.lit(False))).alias("counts"))
    case = F.struct("encounter_id", "admit", "discharge", "mdc", "block", "year", "admit_type", "discharge_type", "site", "__mdc")
    episodes = rows.groupBy("person_id", "episode_id").agg(
        F.min_by(seat, F.struct((~opening).alias("k"), pos.alias("p"))).alias("o"),
        F.collect_list(F.when(F.col("is_case"), case)).alias("zs"),  # one, where only the last row of an episode is a case
    )
    z_type = episodes.schema["zs"].dataType.elementType
    place = lambda side, mdc, hit, z: F.struct(
        F.col("o.admit").alias("p1"), F.col("o.discharge").alias("p2"), F.col("o.encounter_id").alias("p3"), F.lit(side).alias("side"), mdc.alias("key"), hit.alias("hit"), z.alias("z")
    )
    hit = F.when(F.col("o.counts"), F.struct(F.col("o.admit").alias("day"), F.col("o.encounter_id").alias("id")))
    no_hit = F.lit(None).cast("struct<day:date,id:bigint>")
    both = episodes.select("person_id", F.inline(F.concat(
        F.array(place(0, F.col("o.__mdc"), hit, F.lit(None).cast(z_type))), F.transform("zs", lambda z: place(1, z["__mdc"], no_hit, z)),
    )))
    # Backwards, a case comes before its own opening: what was passed so far are the later openings.
    back = [F.desc("p1"), F.desc("p2"), F.desc("p3"), F.desc("side")]
    hits = running_last(F.col("hit"), F.struct("p1", "p2", "p3"), backwards=True)
    passed = carried(both, ["person_id"], month_of("p1"), back, "next", hits, backwards=True)
    cases = carried(passed, ["person_id", "key"], month_of("p1"), back, "next_mdc", hits, backwards=True).where("side = 1")
    cases = cases.select("person_id", "z.*", "next", "next_mdc").drop("__mdc").withColumn("__key", comparable_mdc(F.col("mdc"), rules))
    days, days_mdc = F.datediff("next.day", "discharge"), F.datediff("next_mdc.day", "discharge")
    end = block_end(rules)
    grouped = {m for g in rules.mdc_groups for m in g}
    without = [m for m in rules.no_related if m not in grouped] if rules.unplanned is not None else []
    has_kin = ~F.coalesce(F.col("mdc").isin(*without), F.lit(False)) if without else F.lit(True)
    out = cases
    for d in rules.windows:
        seen = F.col("discharge") <= F.date_sub(end, d + rules.margin)
        kin = F.col("__key").isNotNull() & F.coalesce(days_mdc <= d, F.lit(False))
        out = out.withColumn(f"readmit_{d}d", F.when(seen, F.coalesce(days <= d, F.lit(False)).cast("int")))
        out = out.withColumn(f"readmit_{d}d_mdc", F.when(seen & has_kin, kin.cast("int")))
    return out.withColumn("days_to_next", days).withColumn("next_id", F.col("next.id")).drop("next", "next_mdc", "__key")


def rates_by(labelled: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Cases, observed cases, positives and rate per group."""
    n = labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count(label).alias("observed"), F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("positives"))
    return n.withColumn("rate", F.round(F.col("positives") / F.nullif("observed", F.lit(0)), 6))


def censoring_bands(labelled: DataFrame, label: str, window: int) -> DataFrame:
    """Per band of days between discharge and 31 December: observed cases, positives and positives whose re-admission
    lies beyond that day, which data ending there could not show."""
    end = F.make_date(F.year("discharge"), F.lit(12), F.lit(31))
    left = F.datediff(end, "discharge")
    band = F.when(left < 7, "00-06").when(left < 15, "07-14").when(left < 22, "15-21").when(left < 31, "22-30").when(left < 61, "31-60").when(left < 91, "61-90").otherwise("91+")
    hidden = (F.col(label) == 1) & (F.date_add("discharge", F.col("days_to_next")) > end)
    return labelled.where(F.col(label).isNotNull()).groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum(label).cast("bigint").alias("positives"), F.sum(hidden.cast("bigint")).alias("invisible")
    )


def site_presence(df: DataFrame) -> DataFrame:
    """First and last year and number of years of each site, and whether it reports in all years of the table."""
    per = df.where("site IS NOT NULL").groupBy("site", "year").agg(F.count(F.lit(1)).alias("n"))
    years = df.agg(F.count_distinct("year").alias("y"))
    return per.groupBy("site").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("years"), F.sum("n").alias("rows")).withColumn(
        "all_years", (F.col("years") == years.scalar()).cast("int")
    )


def site_rate_quantiles(labelled: DataFrame, label: str, least: int = 20) -> DataFrame:
    """Five-number summary of the sites' rates, over sites with at least `least` observed cases."""
    rates = labelled.groupBy("site").agg(F.count(label).alias("n"), F.avg(label).alias("rate")).where(F.col("n") >= least)
    q = F.percentile("rate", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return rates.agg(F.count(F.lit(1)).alias("sites"), q.alias("q")).select(
        "sites", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("lowest", "q1", "median", "q3", "highest")))
    )
