"""Ordered, configurable exclusion rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """flag names a boolean column. role CASE removes the row as an index case only; BOTH also as a re-admission."""

    code: str
    flag: str
    role: str = "CASE"
    active: bool = True
    required: bool = False


def validate_rules(rules: list[Rule], changes: dict[str, bool] | None = None) -> list[Rule]:
    """The rules after overrides; raises ValueError on repeated codes, unknown roles or codes and on switching a required
    rule off."""
    changes = changes or {}
    codes = [r.code for r in rules]
    if len(set(codes)) != len(codes):
        raise ValueError("rule codes must be unique")
    if unknown := set(changes) - set(codes):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    if bad := [r.code for r in rules if r.role not in ("CASE", "BOTH")]:
        raise ValueError(f"role must be CASE or BOTH: {bad}")
    out = [Rule(r.code, r.flag, r.role, changes.get(r.code, r.active), r.required) for r in rules]
    if off := [r.code for r in out if r.required and not r.active]:
        raise ValueError(f"required rules can't be off: {off}")
    return out


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def disjoint_kinds(periodic: tuple[str, ...], unplanned: tuple[str, ...] | None) -> None:
    """Raises ValueError if an admission type of periodic treatments also counts as unplanned: the rule takes cases only, so such an
    admission would still count as a re-admission."""
    if both := set(periodic) & set(unplanned or ()):
        raise ValueError(f"types that are both periodic and unplanned: {sorted(both)}")


def trackable(rules: list[Rule]) -> Column:
    """A row that can be followed: it has a person and dates in order and meets no active rule of the role BOTH."""
    out = F.col("person_id").isNotNull() & (F.col("discharge") >= F.col("admit"))
    for r in rules:
        if r.active and r.role == "BOTH":
            out = out & ~F.col(r.flag)
    return false_if_null(out)


def mark_not_final(df: DataFrame) -> DataFrame:
    """Adds not_final: a trackable row that isn't the last of its episode's trackable rows by (discharge, admit, id). The last is a
    max over structs, one state per task and episode."""
    rows = df.where("trackable AND episode_id IS NOT NULL")
    last = rows.groupBy("episode_id").agg(F.max(F.struct("discharge", "admit", "encounter_id")).alias("z"))
    ends = last.select(F.col("z.encounter_id").alias("encounter_id"), F.lit(True).alias("__final"))
    return df.join(ends, "encounter_id", "left").withColumn("not_final", F.col("trackable") & F.col("__final").isNull()).drop("__final")


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds reason (first active rule met, in table order), is_case (none met) and may_readmit.

    df has one boolean column per rule and trackable; may_readmit: a trackable row that opens an episode
    (encounter_id = episode_id). A rule of the role CASE removes the row as a case only.
    """
    reason = F.lit(None).cast("string")
    for r in reversed(rules):
        if r.active:
            reason = F.when(F.col(r.flag), r.code).otherwise(reason)
    out = df.withColumn("reason", reason)
    opens = F.col("encounter_id").eqNullSafe(F.col("episode_id"))
    return out.withColumn("is_case", F.col("reason").isNull()).withColumn("may_readmit", F.col("trackable") & opens)


def waterfall(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(step, code, active, met, removed, remaining, would_remove) from one aggregate over the rows.

    removed: rows whose first active rule this is. would_remove: rows an inactive rule would remove that no active rule
    removes.
    """
    n = lambda c: F.sum(c.cast("bigint"))
    sums = [F.count(F.lit(1)).alias("total")]
    for i, r in enumerate(rules):
        sums += [n(F.col(r.flag)).alias(f"m{i}"), n(F.coalesce(F.col("reason") == r.code, F.lit(False))).alias(f"r{i}"), n(F.col(r.flag) & F.col("is_case")).alias(f"w{i}")]
    steps = F.array(*(
        F.struct(F.lit(i + 1).alias("step"), F.lit(r.code).alias("code"), F.lit(int(r.active)).alias("active"), F.col(f"m{i}").alias("met"),
                 F.col(f"r{i}").alias("removed"), F.when(F.lit(not r.active), F.col(f"w{i}")).alias("would_remove"), F.col("total"))
        for i, r in enumerate(rules)
    ))
    one = df.agg(*sums).select(F.inline(steps))
    gone = F.sum("removed").over(Window.orderBy("step"))  # one row per rule
    return one.withColumn("remaining", F.col("total") - gone).drop("total")


def periodic_treatment(df: DataFrame, candidate: Column, days: int = 365, least: int = 2) -> DataFrame:
    """Adds periodic: a candidate row with at least `least` earlier candidate admissions of the same person and
    diagnosis category on the days [admit - days, admit - 1]. A range frame over the day number; days are summed first,
    so a person with many rows on one day is one frame entry."""
    cat = F.substring(F.replace("dx", F.lit("."), F.lit("")), 1, 3)
    marked = df.withColumn("__cat", cat).withColumn("__day", F.unix_date("admit"))
    ok = candidate & F.col("person_id").isNotNull() & F.col("__cat").isNotNull() & F.col("__day").isNotNull()
    daily = marked.where(ok).groupBy("person_id", "__cat", "__day").agg(F.count(F.lit(1)).alias("__n"))
    frame = Window.partitionBy("person_id", "__cat").orderBy("__day").rangeBetween(-days, -1)
    before = daily.withColumn("__before", F.sum("__n").over(frame)).drop("__n")
    flagged = marked.withColumn("__ok", false_if_null(ok)).join(before, ["person_id", "__cat", "__day"], "left")
    return flagged.withColumn("periodic", F.col("__ok") & false_if_null(F.col("__before") >= least)).drop("__cat", "__day", "__ok", "__before")


def scenario_diff(base: DataFrame, other: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(added, removed, changed, same) cases between two runs, by full outer join on the key."""
    a = base.select(key, *(F.col(c).alias(f"a_{c}") for c in labels), F.lit(True).alias("a"))
    b = other.select(key, *(F.col(c).alias(f"b_{c}") for c in labels), F.lit(True).alias("b"))
    equal = F.lit(True)
    for c in labels:
        equal = equal & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    j = a.join(b, key, "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(n(F.col("a").isNull()).alias("added"), n(F.col("b").isNull()).alias("removed"), n(both & ~equal).alias("changed"), n(both & equal).alias("same"))
