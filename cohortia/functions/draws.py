"""Reproducible draws: a hash of (seed, purpose, key) in place of a random generator.

Independent of partitioning and row order, and expressible in any engine with md5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(seed: int, purpose: str, *key: Column) -> Column:
    """A whole number from 0 to 16**15 - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sql_draw(seed: int, purpose: str, *key: str) -> str:
    text = "concat_ws('|', " + ", ".join([f"'{seed}'", f"'{purpose}'", *(f"CAST({k} AS VARCHAR)" for k in key)]) + ")"
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


QUARTER = 16**8  # values of a quarter of a hash


def exploded_draws(df: DataFrame, draws: int, seed: int, purpose: str, key: str) -> DataFrame:
    """df once for each draw 1..draws with __u, a whole number below QUARTER: four draws share one hash."""
    blocks = df.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))))
    hashed = blocks.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), F.col("__b").cast("string"), F.col(key).cast("string"))))
    each = hashed.withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("draw", F.col("__b") * 4 + F.col("__q") + 1)
    u = F.conv(F.substring("__h", F.col("__q") * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
    return each.where(F.col("draw") <= draws).withColumn("__u", u).drop("__b", "__h", "__q")


def sql_exploded_draw(seed: int, purpose: str, draw: str, key: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{purpose}', CAST(({draw} - 1) // 4 AS VARCHAR), CAST({key} AS VARCHAR))), CAST((({draw} - 1) % 4) * 8 + 1 AS INTEGER), 8) AS BIGINT)"


def poisson_steps(rate: float = 1.0, most: int = 12) -> list[float]:
    """The cumulated probabilities of 0, 1, ... below most: a share's place among them is its Poisson count."""
    total, term, out = 0.0, math.exp(-rate), []
    for k in range(most):
        total += term
        out.append(total)
        term *= rate / (k + 1)
    return out


def poisson_weight(u: Column, rate: float = 1.0, most: int = 12, span: int = 16**15) -> Column:
    """A Poisson count from a draw, by inversion; each unit's bootstrap weight without any exchange of state."""
    share = u.cast("double") / F.lit(float(span))
    out = F.lit(most)
    for k, c in reversed(list(enumerate(poisson_steps(rate, most)))):
        out = F.when(share < F.lit(c), k).otherwise(out)
    return out


def sql_poisson(u: str, rate: float = 1.0, most: int = 12, span: int = 16**15) -> str:
    cases = [f"WHEN CAST({u} AS DOUBLE) / {float(span)!r}::DOUBLE < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(poisson_steps(rate, most))]
    return "CASE " + " ".join(cases) + f" ELSE {most} END"
