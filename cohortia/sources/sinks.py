"""Writers with read-back checks."""

from __future__ import annotations

import os
import stat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions.text import spanish_number


def write_table(df: DataFrame, path: str) -> None:
    """zstd Parquet; the commit protocol makes the files appear together."""
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)


def append_columns(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the columns of new, by key; both sides must have the same keys."""
    lone = table.select(key).exceptAll(new.select(key)).limit(1).count() + new.select(key).exceptAll(table.select(key)).limit(1).count()
    if lone:
        raise ValueError(f"the tables don't have the same {key}")
    return table.join(new, key)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with `side`; empty when both hold the same rows as often."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def verify_written(df: DataFrame, path: str, key: str) -> None:
    """Raises if the table at path has another schema, keys or content hash than df."""
    back = df.sparkSession.read.parquet(path)
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError("schema differs")
    if fingerprint(back) != fingerprint(df):
        raise ValueError("content differs")


def fingerprint(df: DataFrame) -> str:
    """Content hash that depends neither on row order nor on files: row count, sum and xor of row hashes, schema."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    r = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return f"{r[0]}-{r[1]}-{r[2]}-{df.schema.simpleString()}"


def append_log(spark: SparkSession, path: str, **entry: str | int | float | bool) -> None:
    """One more row of a run log, with the time; earlier rows are never rewritten."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    row = spark.createDataFrame([tuple(entry.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in entry.items()))
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def split_write(df: DataFrame, label: str, paths: dict[str, str], sealed: tuple[str, ...] = ()) -> None:
    """One table per label value; those in `sealed` are left read-only where the path is local."""
    for value, path in paths.items():
        write_table(df.where(F.col(label) == value), path)
        if value in sealed and os.path.isdir(path):
            for f in os.listdir(path):
                os.chmod(os.path.join(path, f), stat.S_IRUSR | stat.S_IRGRP | stat.S_IROTH)


def export_columns(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Text columns for a ';' export with decimal comma."""
    def text(c: str, kind: str) -> Column:
        return spanish_number(F.col(c), decimals) if kind in ("double", "float") else F.col(c).cast("string")

    return df.select(*(text(c, k).alias(c) for c, k in df.dtypes))


def export_csv(df: DataFrame, path: str, decimals: int = 6) -> None:
    """';'-separated, decimal comma, with byte-order mark at the head of the header; for small result tables."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        import csv

        out = csv.writer(f, delimiter=";")
        out.writerow(df.columns)
        for r in export_columns(df, decimals).toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
