"""Profiling and control tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.text import short_mask


def long_form(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep, column, value) of several columns as strings, one row per cell; no shuffle."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(*keep, F.inline(cells))


def column_profile(df: DataFrame, columns: list[str], tokens: tuple[str, ...]) -> DataFrame:
    """(column, rows, filled, tokens, distinct_values, formats): tokens counts cells whose trimmed upper-case text is a no-data
    word; formats the distinct short masks. Distinct values are exact, in two combined steps."""
    cells = long_form(df, columns)
    per = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    there = F.col("value").isNotNull() & (F.trim("value") != "")
    masks = per.where(there).select("column", short_mask(F.col("value")).alias("m")).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("formats"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    base = per.groupBy("column").agg(
        F.sum("n").alias("rows"), n(there).alias("filled"), n(F.coalesce(F.upper(F.trim("value")).isin(*tokens), F.lit(False))).alias("tokens"),
        F.count("value").alias("distinct_values"),
    )
    return base.join(F.broadcast(masks), "column", "left").fillna(0, ["formats"])  # one row per column


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) with missing as a value; the share divides by a scalar total."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return n.withColumn("share", F.round(F.col("n") / total.scalar(), 6))


def catalog_coverage(df: DataFrame, fields: dict[str, Column], catalog: DataFrame) -> DataFrame:
    """(field, occurrences, found, codes, codes_found): coverage of code columns by a catalog (field, code). Codes are counted
    before they are looked up, so the join is on distinct codes."""
    cells = F.array(*(F.struct(F.lit(k).alias("field"), c.alias("code")) for k, c in fields.items()))
    n = df.select(F.inline(cells)).where("code IS NOT NULL").groupBy("field", "code").agg(F.count(F.lit(1)).alias("n"))
    known = catalog.select("field", "code", F.lit(1).alias("k")).distinct()
    j = n.join(known, ["field", "code"], "left")
    return j.groupBy("field").agg(
        F.sum("n").alias("occurrences"), F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).alias("found"),
        F.count(F.lit(1)).alias("codes"), F.count("k").alias("codes_found"),
    )


def missing_codes(df: DataFrame, code: Column, known: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent codes outside the catalog (column code)."""
    n = df.select(code.alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return n.join(known.select("code").distinct(), "code", "left_anti").orderBy(F.desc("n"), "code").limit(k)


def null_share(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Share of missing cells per column and group, from one aggregate."""
    sums = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"k{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.round(1 - F.col(f"k{i}") / F.col("rows"), 6).alias("missing")) for i, c in enumerate(columns)))
    return sums.select(by, F.inline(rows))


def control_table(df: DataFrame) -> DataFrame:
    """Per file year: rows, months with discharges, patients, sites, mean stay, median and mean weight, share without id."""
    stay = F.datediff("discharge", "admit")
    base = df.groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.month("discharge")).alias("months"),
        F.round(F.avg(stay), 6).alias("mean_stay"), F.round(F.percentile("weight", F.lit(0.5)), 6).alias("median_weight"),
        F.round(F.avg(F.col("patient_id").isNull().cast("int")), 6).alias("no_id"), F.round(F.avg("n_dx"), 6).alias("mean_dx"),
    )
    patients = df.groupBy("year", "patient_id").agg(F.count(F.lit(1)).alias("n")).groupBy("year").agg(F.count("patient_id").alias("patients"))
    sites = df.groupBy("year", "site").agg(F.count(F.lit(1)).alias("n")).groupBy("year").agg(F.count("site").alias("sites"))
    return base.join(patients, "year").join(sites, "year")


def month_counts(df: DataFrame, day: str) -> DataFrame:
    """Rows per year and month as a table of twelve columns."""
    months = (F.count(F.when(F.month(day) == m, 1)).alias(f"m{m:02d}") for m in range(1, 13))
    return df.where(F.col(day).isNotNull()).groupBy(F.year(day).alias("y")).agg(*months)


def reappearance(df: DataFrame) -> DataFrame:
    """Per year, identifiers and how many of them appear in the next year too, from one row per (identifier, year)."""
    held = df.where("patient_id IS NOT NULL").select("patient_id", "year").distinct()
    nxt = F.lead("year").over(Window.partitionBy("patient_id").orderBy("year"))
    return held.withColumn("next", nxt).groupBy("year").agg(F.count(F.lit(1)).alias("ids"), F.sum(F.coalesce((F.col("next") == F.col("year") + 1).cast("int"), F.lit(0))).cast("bigint").alias("again"))


def data_dictionary(df: DataFrame, year: str, columns: list[str]) -> DataFrame:
    """(column, type, distinct_values, least, greatest, filled, filled_least_year, filled_greatest_year)."""
    types = dict(df.dtypes)
    per = long_form(df, columns, year).groupBy("column", year, "value").agg(F.count(F.lit(1)).alias("n"))
    by_year = per.groupBy("column", year).agg((F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("f"), F.sum("n").alias("n"))
    shares = by_year.groupBy("column").agg(F.round(F.sum(F.col("f") * F.col("n")) / F.sum("n"), 6).alias("filled"), F.round(F.min("f"), 6).alias("filled_least_year"), F.round(F.max("f"), 6).alias("filled_greatest_year"))
    values = per.groupBy("column", "value").agg(F.sum("n").alias("n")).groupBy("column").agg(F.count("value").alias("distinct_values"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    kind = F.create_map(*(x for c in columns for x in (F.lit(c), F.lit(types[c]))))
    return values.join(shares, "column").withColumn("type", kind[F.col("column")])


def expand_spec(spec: str) -> list[str]:
    """'diagnostico{2-35}' -> its numbered columns."""
    import re

    m = re.fullmatch(r"(.*)\{(\d+)-(\d+)\}(.*)", spec)
    return [f"{m[1]}{i}{m[4]}" for i in range(int(m[2]), int(m[3]) + 1)] if m else [spec]
