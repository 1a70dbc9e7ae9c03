"""Small rule tables and spreadsheets."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession


def read_rules(path: str, required: tuple[str, ...] = ()) -> list[dict[str, str]]:
    """A ';'-separated table with header, with or without byte-order mark. An extra ';' in a row, an empty table or a
    missing column is an error."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.DictReader(f, delimiter=";"))
    if not rows:
        raise ValueError(f"{path} has no rows")
    for i, r in enumerate(rows, 2):
        if None in r or None in r.values():
            raise ValueError(f"{path}, line {i}: wrong number of fields")
    if missing := set(required) - set(rows[0]):
        raise ValueError(f"{path}: columns missing: {sorted(missing)}")
    return rows


def rules_frame(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    rows = read_rules(path, required)
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def read_catalog(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(code) from the first column of a spreadsheet, zero-filled to width; needs a spreadsheet reader for pandas."""
    import pandas as pd

    first = pd.read_excel(path, dtype=str).iloc[:, 0].dropna().str.strip()
    codes = first.str.zfill(width) if width else first
    return spark.createDataFrame([(c,) for c in codes.drop_duplicates()], "code string")
