"""Yearly delimited extracts: audit, repair, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortia.operators.skew import sized_join


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(value, file, block): the lines of text files in any encoding that Python knows, without byte-order mark and line end; block
    is the byte at which the line's part of the file begins.

    UTF-8 goes through the splittable text source. Other encodings are decoded as whole files, one task each, as UTF-16
    can't be split at byte offsets.
    """
    name = encoding.lower().replace("_", "-")
    if name in ("utf-8", "utf8", "utf-8-sig"):
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    else:
        def decode(batches):
            for b in batches:
                for p, c in zip(b["path"], b["content"]):
                    text = bytes(c).decode(encoding)
                    import pandas as pd

                    rows = text.removesuffix("\n").split("\n") if text else []
                    yield pd.DataFrame({"value": [r.removesuffix("\r") for r in rows], "file": p})

        lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "value string, file string").withColumn("block", F.lit(0).cast("bigint"))
    clean = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r$", "")
    return lines.select(clean.alias("value"), "file", "block")


def numbered_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(value, file, line): line numbers from 1 in each file's order.

    Lines are numbered inside the JVM: each part of a file counts its own, and the parts before it, one row a part, are added.
    """
    lines = read_lines(spark, path, encoding).withColumn("__m", F.monotonically_increasing_id())
    parts = lines.groupBy("file", "block").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("file", "block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return sized_join(lines, offsets, ["file", "block"], "inner").select("value", "file", (F.col("__m") + F.col("__shift")).alias("line"))


def audit_lines(lines: DataFrame, fields: int, sep: str = "|") -> DataFrame:
    """(file, line, n_fields) of the lines whose number of fields differs."""
    n = F.size(F.split("value", f"[{sep}]", -1))
    return lines.withColumn("n_fields", n).where(F.col("n_fields") != fields).select("file", "line", "n_fields")


def parse_fields(lines: DataFrame, header: list[str], sep: str = "|", strict: bool = True) -> DataFrame:
    """Columns of the header as text. Overflow stays in the last field; empty fields stay ''. Too few fields are an error
    when strict, else missing."""
    parts = F.split("value", f"[{sep}]", len(header))
    out = lines.withColumn("__p", parts)
    if strict:
        short = F.size("__p") < len(header)
        message = F.concat(F.lit("line with too few fields: "), F.substring("value", 1, 80))
        out = out.withColumn("__p", F.when(short, F.raise_error(message).cast("array<string>")).otherwise(F.col("__p")))
    keep = [c for c in lines.columns if c != "value"]
    return out.select(*(F.get("__p", F.lit(i)).alias(h) for i, h in enumerate(header)), *keep)


def read_delimited(spark: SparkSession, path: str, year: int, encoding: str = "utf-8", sep: str = "|", rename: dict[str, str] | None = None) -> DataFrame:
    """A yearly extract: all fields as text, renamed where the header drifted, with anio_archivo, archivo_origen and
    fila_origen (the header is line 1)."""
    lines = numbered_lines(spark, path, encoding)
    header = lines.where("line = 1").select("value").first()[0].split(sep)
    names = [(rename or {}).get(h, h) for h in header]
    body = lines.where("line > 1 AND value <> ''")
    rows = parse_fields(body, names, sep)
    return rows.withColumn("anio_archivo", F.lit(year).cast("smallint")).withColumn("archivo_origen", F.element_at(F.split("file", "/"), -1)).withColumnRenamed("line", "fila_origen").drop("file")


def project_by_position(df: DataFrame, places: dict[int, str]) -> DataFrame:
    return df.select(*(F.col(f"`{df.columns[i]}`").alias(n) for i, n in places.items()))


def union_years(frames: list[DataFrame], key: str = "encounter_id") -> DataFrame:
    """Stack yearly tables of one schema and give each row its key: year * 10**7 + source line."""
    out = frames[0]
    for f in frames[1:]:
        if f.schema.simpleString() != out.schema.simpleString():
            raise ValueError("yearly tables must share one schema")
        out = out.unionByName(f)
    return out.withColumn(key, F.col("anio_archivo").cast("bigint") * 10_000_000 + F.col("fila_origen"))
