"""History, comorbidity and category features of index cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.ordered import running_sums
from cohortia.operators.skew import sized_join


def history(cases: DataFrame, events: DataFrame, days: int, measures: dict[str, Column]) -> DataFrame:
    """cases (encounter_id, person_id, admit, episode_id) with, per measure, the number of other episodes whose end lies in
    [admit - days, admit].

    events has one row per episode (person_id, episode_id, end). Events and case days are first reduced to one row per person and
    day, so a person with a third of all rows is as many as the calendar has days; counts are the difference of two growing
    frames. Cases take them by person and day, and the own episode is subtracted where its end falls in the window.
    """
    marks = {m: F.coalesce(c.cast("int"), F.lit(0)) for m, c in measures.items()}
    ev = events.where("person_id IS NOT NULL").select("person_id", "episode_id", F.unix_date("end").alias("day"), *(c.alias(m) for m, c in marks.items()))
    own = ev.select("episode_id", F.col("day").alias("__own"), *(F.col(m).alias(f"__own_{m}") for m in measures))
    ca = cases.where("person_id IS NOT NULL").select("encounter_id", "person_id", "episode_id", F.unix_date("admit").alias("day"))
    asked = ca.select("person_id", "day", *(F.lit(0).alias(m) for m in measures))
    daily = ev.drop("episode_id").unionByName(asked).groupBy("person_id", "day").agg(*(F.sum(m).alias(m) for m in measures))
    order = Window.partitionBy("person_id").orderBy("day")
    upto = lambda m, last: F.coalesce(F.sum(m).over(order.rangeBetween(Window.unboundedPreceding, last)), F.lit(0))
    counts = daily.select("person_id", "day", *((upto(m, 0) - upto(m, -days - 1)).alias(m) for m in measures))
    joined = ca.join(counts, ["person_id", "day"]).join(own, "episode_id", "left")
    inside = F.coalesce(F.col("__own").between(F.col("day") - days, F.col("day")), F.lit(False))
    return joined.select(
        "encounter_id", "person_id", "episode_id",
        *((F.col(m) - F.when(inside, F.col(f"__own_{m}")).otherwise(0)).cast("bigint").alias(m) for m in measures),
    )


def days_since_last(cases: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """(encounter_id, days_since): days from the latest end of another episode to the admission, days + 1 if that is further
    back or there is none. As-of join by a running last over one row per person and day; as an episode's own end can only be
    the latest, ends are kept with the smallest and greatest episode, which tells whether another one shares the day."""
    ends = events.groupBy("person_id", F.unix_date("end").alias("day")).agg(F.min("episode_id").alias("e0"), F.max("episode_id").alias("e1"))
    ca = cases.where("person_id IS NOT NULL").select("encounter_id", "person_id", F.unix_date("admit").alias("day"), F.col("episode_id").alias("own"))
    order = Window.partitionBy("person_id").orderBy("day")
    marked = ends.withColumn("before", F.lag("day").over(order)).select("person_id", "day", F.struct("day", "e0", "e1", "before").alias("e"))
    daily = marked.unionByName(ca.select("person_id", "day", F.lit(None).cast(marked.schema["e"].dataType).alias("e"))).groupBy("person_id", "day").agg(F.max("e").alias("e"))
    found = ca.join(daily.withColumn("e", F.last("e", ignorenulls=True).over(order)), ["person_id", "day"])
    only_own = (F.col("e.e0") == F.col("own")) & (F.col("e.e1") == F.col("own"))
    end = F.when(only_own, F.col("e.before")).otherwise(F.col("e.day"))
    return found.select("encounter_id", F.least(F.coalesce(F.col("day") - end, F.lit(days + 1)), F.lit(days + 1)).cast("bigint").alias("days_since"))


def comorbidity(pairs: DataFrame, prefixes: DataFrame, replaces: list[tuple[str, str]], record_id: str) -> DataFrame:
    """(record, conditions, score): distinct conditions whose prefixes the record's codes start with and their summed
    weights; a severe condition clears the mild one after all marks.

    Prefixes (condition, prefix, weight) are matched with the distinct codes only; the small result is joined back.
    """
    marks = condition_marks(pairs, prefixes, record_id)
    per = marks.groupBy(record_id).agg(F.map_from_entries(F.collect_list(F.struct("condition", "weight"))).alias("m"))
    keep = F.col("m")
    for severe, mild in replaces:
        keep = F.when(F.map_contains_key(F.col("m"), F.lit(severe)), _without(keep, mild)).otherwise(keep)
    return per.withColumn("m", keep).select(record_id, F.size("m").alias("conditions"), F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, w: a + w).alias("score"))


def condition_marks(pairs: DataFrame, prefixes: DataFrame, record_id: str) -> DataFrame:
    """Distinct (record, condition, weight) by prefix of the bare code; prefixes is a rule table."""
    codes = pairs.select("code").distinct().withColumn("bare", F.replace("code", F.lit("."), F.lit("")))
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
    tries = codes.select("code", F.explode(F.array_distinct(F.array(*(F.substring("bare", 1, n) for n in lengths)))).alias("prefix"))
    matched = tries.join(F.broadcast(prefixes), "prefix").select("code", "condition", "weight").distinct()
    return pairs.join(matched, "code").select(record_id, "condition", "weight").distinct()


def condition_rates(marks: DataFrame, cases: DataFrame, record_id: str, label: str) -> DataFrame:
    """(condition, n, prevalence, rate) among cases with a label."""
    known = cases.where(F.col(label).isNotNull()).select(record_id, F.col(label).cast("double").alias("__y"))
    total = known.agg(F.count(F.lit(1)).alias("t"))
    g = marks.join(known, record_id).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("__y"), 6).alias("rate"))
    return g.withColumn("prevalence", F.round(F.col("n") / total.scalar(), 6))


def _without(marks: Column, condition: str) -> Column:
    return F.map_filter(marks, lambda k, v: k != condition)


def merge_rare(df: DataFrame, column: str, least: int = 100, other: str = "OTRO", missing: str = "SIN DATO") -> DataFrame:
    """column with null as `missing` and categories of fewer than `least` rows as `other`. The frequent categories, at most one in
    `least` rows, are joined by checked size, so that a value with a third of all rows isn't shuffled."""
    value = F.coalesce(F.col(column), F.lit(missing))
    common = df.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(column, F.lit(True).alias("__common"))
    joined = sized_join(df.withColumn(column, value), common, [column])
    return joined.withColumn(column, F.when(F.col("__common"), F.col(column)).otherwise(other)).drop("__common")


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n, positives, auroc), ties counting half. Rows are first summed per distinct score; the running sums over those are
    spread by range."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = known.groupBy(score).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("q"))
    pairs = running_sums(per, [], [score], {"upto": "q"}, "valores").withColumn("won", F.col("p") * (F.col("upto") - F.col("q") / 2))
    return pairs.agg((F.sum("p") + F.sum("q")).cast("bigint").alias("n"), F.sum("p").cast("bigint").alias("positives"), F.round(F.sum("won") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0)), 6).alias("auroc"))


def extreme_categories(df: DataFrame, columns: list[str], label: str, least: int = 1000) -> DataFrame:
    """Per column the categories with the lowest and highest rate among those with at least `least` observed rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("SIN DATO")).alias("value")) for c in columns))
    rates = df.where(F.col(label).isNotNull()).select(label, F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate")).where(F.col("n") >= least)
    return rates.groupBy("column").agg(
        F.min_by("value", F.struct("rate", "value")).alias("lowest"), F.round(F.min("rate"), 6).alias("lowest_rate"),
        F.max_by("value", F.struct("rate", "value")).alias("highest"), F.round(F.max("rate"), 6).alias("highest_rate"),
    )
