"""Discrimination, calibration and bootstrap intervals of predicted probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.draws import QUARTER, exploded_draws, poisson_steps, poisson_weight
from cohortia.operators.ordered import running_sums
from cohortia.session import cut


def score_table(df: DataFrame, score: str, label: str, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by, score, p, q): weighted positives and negatives per distinct score; all ranking metrics read this table."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    y = F.col(label).cast("double")
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, F.col(score).alias("score")).agg(F.sum(w * y).alias("p"), F.sum(w * (1 - y)).alias("q"))


def ranking_metrics(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """auprc (average precision) and auroc per group; equal scores are one threshold.

    scores has one row per group and distinct score, which may still be many: the running sums are spread by range.
    """
    totals = scores.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    ranked = running_sums(scores, list(by), [F.desc("score")], {"tp": "p", "fp": "q"}, "umbrales")
    if by:
        cum = ranked.join(totals, list(by))
    else:
        whole = totals.select(F.struct("all_p", "all_q").alias("t")).scalar()
        cum = ranked.withColumn("t", whole).select("*", "t.all_p", "t.all_q")
    step = cum.withColumn("ap", F.col("p") / F.nullif("all_p", F.lit(0.0)) * F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0.0)))
    won = F.col("q") * (F.col("tp") - F.col("p") / 2)  # positives above, ties half
    return step.groupBy(*by).agg(
        F.round(F.sum("ap"), 6).alias("auprc"), F.round(F.sum(won) / F.nullif(F.max("all_p") * F.max("all_q"), F.lit(0.0)), 6).alias("auroc"),
    )


def brier(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, prevalence, Brier score and that of the constant prevalence."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    y = F.col(label).cast("double")
    g = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("prev"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("b"))
    return g.select(*by, "n", F.round("prev", 6).alias("prevalence"), F.round("b", 6).alias("brier"), F.round(F.col("prev") * (1 - F.col("prev")), 6).alias("reference_brier"))


def guarded_logit(score: Column) -> Column:
    """logit with exact 0 and 1 replaced by 1e-4 and 1 - 1e-4."""
    s = F.when(score == 0, 1e-4).when(score == 1, 1 - 1e-4).otherwise(score)
    return F.ln(s / (1 - s))


def calibration(df: DataFrame, score: str, label: str, by: str | None = None, rounds: int = 50, tolerance: float = 1e-9) -> list[tuple]:
    """(group, intercept, slope_intercept, slope) per group of `by`, or one with group None: the intercept with the logit as offset,
    and the slope with its own intercept, by damped Newton.

    Scores are reduced to distinct values once and written; each round is one small aggregate of that table for all groups, of
    which only the sums reach the driver: groups are few, such as years. Steps are capped at 1.
    """
    group = F.lit("") if by is None else F.col(by).cast("string")
    named = df.where(group.isNotNull()).withColumn("__g", group)
    scores = cut(score_table(named, score, label, ("__g",)).select("__g", guarded_logit(F.col("score")).alias("x"), "p", "q"), "calibracion")
    groups = [r[0] for r in scores.select("__g").distinct().orderBy("__g").collect()]

    def sums(at: dict[str, tuple[float, float]]) -> dict[str, np.ndarray]:
        look = lambda i: F.create_map(*(F.lit(v) for g, ab in at.items() for v in (g, ab[i])))[F.col("__g")]
        m = 1 / (1 + F.exp(-(look(0) + look(1) * F.col("x"))))
        n = F.col("p") + F.col("q")
        g, h = F.col("p") - n * m, n * m * (1 - m)
        rows = scores.where(F.col("__g").isin(list(at))).groupBy("__g").agg(F.sum(g), F.sum(g * F.col("x")), F.sum(h), F.sum(h * F.col("x")), F.sum(h * F.col("x") * F.col("x")))
        return {r[0]: np.array([float(v or 0) for v in r[1:]]) for r in rows.collect()}

    offsets, lines = dict.fromkeys(groups, 0.0), dict.fromkeys(groups, (0.0, 1.0))
    open_groups = set(groups)
    for _ in range(rounds):
        if not open_groups:
            break
        for g, s in sums({g: (offsets[g], 1.0) for g in open_groups}).items():
            step = float(np.clip(s[0] / s[2] if s[2] else 0.0, -1, 1))
            offsets[g] += step
            if abs(step) < tolerance:
                open_groups.discard(g)
    open_groups = set(groups)
    for _ in range(rounds):
        if not open_groups:
            break
        for g, s in sums({g: lines[g] for g in open_groups}).items():
            info = np.array([[s[2], s[3]], [s[3], s[4]]])
            if abs(np.linalg.det(info)) < 1e-18:
                open_groups.discard(g)
                continue
            step = np.clip(np.linalg.solve(info, s[:2]), -1, 1)
            lines[g] = (lines[g][0] + float(step[0]), lines[g][1] + float(step[1]))
            if np.abs(step).max() < tolerance:
                open_groups.discard(g)
    return [(None if by is None else g, offsets[g], *lines[g]) for g in groups]


def bootstrap_weights(units: DataFrame, unit: str, draws: int, seed: int = 18) -> DataFrame:
    """(draw, unit, w): Poisson bootstrap weights of distinct units, the same for every model; zero weights left out."""
    each = exploded_draws(units.select(unit).where(F.col(unit).isNotNull()).distinct(), draws, seed, "bootstrap", unit)
    return each.withColumn("w", poisson_weight(F.col("__u"), span=QUARTER)).where("w > 0").select("draw", unit, "w")


def bootstrap_metrics(df: DataFrame, unit: str, score: str, label: str, draws: int, seed: int = 18, rows: int = 2000) -> DataFrame:
    """(draw, auprc, auroc): rows take their unit's weight of bootstrap_weights(), worked out in place, so no weights table is joined.

    Rows of one unit, score and label are summed first. Arrow batches then draw `rows` of them at a time for all draws as one matrix and
    sum it by score in a table of at most about twice as many scores, so what is shuffled is partial sums per draw and score,
    never rows times draws.
    """
    known = df.where(F.col(unit).isNotNull() & F.col(score).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(unit).cast("string").alias("u"), F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    # Small rows bring `draws` weights each: tasks are cut for the work, not for the bytes.
    known = known.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u")
    steps = np.array(poisson_steps())
    blocks = range((draws - 1) // 4 + 1)

    def flush(values: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        i, d = np.nonzero(p + q)
        return pa.RecordBatch.from_arrays([pa.array(d + 1, pa.int32()), pa.array(values[i]), pa.array(p[i, d]), pa.array(q[i, d])], ["draw", "score", "p", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.empty(0), np.empty((0, draws)), np.empty((0, draws)))
        values, p, q = empty  # sums of the scores seen so far
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                units, s, y, n = whole.slice(at, rows).columns
                digests = b"".join(md5(f"{seed}|bootstrap|{b}|{u}".encode()).digest() for u in units.to_pylist() for b in blocks)
                u = np.frombuffer(digests, ">u4").reshape(len(units), -1)[:, :draws]
                w = np.searchsorted(steps, u / QUARTER, side="right") * n.to_numpy()[:, None]
                own, place = np.unique(s.to_numpy(), return_inverse=True)
                order = np.argsort(place, kind="stable")
                starts = np.searchsorted(place[order], np.arange(len(own)))
                known = np.union1d(values, own)
                held, new = np.searchsorted(known, values), np.searchsorted(known, own)
                y = y.to_numpy()[order, None]
                sums = []
                for old, v in ((p, y), (q, 1 - y)):
                    both = np.zeros((len(known), draws))
                    both[held] = old
                    both[new] += np.add.reduceat(w[order] * v, starts, axis=0)
                    sums.append(both)
                values, (p, q) = known, sums
                if len(values) > rows:
                    yield flush(values, p, q)
                    values, p, q = empty
        if len(values):
            yield flush(values, p, q)

    drawn = known.mapInArrow(run, "draw int, score double, p double, q double")
    weighed = drawn.groupBy("draw", "score").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return ranking_metrics(cut(weighed, "sorteos"), ("draw",))


def percentile_interval(draws: DataFrame, columns: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(metric, low, high) by linear interpolation."""
    q = draws.agg(*(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(c) for c in columns))
    return q.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.col(c)[0], 6).alias("low"), F.round(F.col(c)[1], 6).alias("high")) for c in columns))))


def paired_falls(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, mean, low, high) of how far a falls behind b over paired draws: auroc in points, auprc as a share of b's."""
    own = lambda t, s: t.select("draw", *(F.col(c).alias(f"{c}_{s}") for c in ("auprc", "auroc")))
    j = own(a, "a").join(own(b, "b"), "draw")
    falls = j.select(((F.col("auprc_b") - F.col("auprc_a")) / F.nullif("auprc_b", F.lit(0.0))).alias("auprc"), (F.col("auroc_b") - F.col("auroc_a")).alias("auroc"))
    q = falls.agg(*(x for c in ("auprc", "auroc") for x in (F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(f"q_{c}"), F.avg(c).alias(f"m_{c}"))))
    return q.select(F.inline(F.array(*(
        F.struct(F.lit(c).alias("metric"), F.col(f"m_{c}").alias("mean"), F.col(f"q_{c}")[0].alias("low"), F.col(f"q_{c}")[1].alias("high")) for c in ("auprc", "auroc")
    ))))


def paired_verdict(a: DataFrame, b: DataFrame, margin_auprc: float = 0.1, margin_auroc: float = 0.02) -> DataFrame:
    """Both falls of a behind b with the joint verdict: LOSES if either interval lies beyond its margin, NOT_WORSE if both lie within
    theirs, else UNDECIDED."""
    falls = paired_falls(a, b).withColumn("margin", F.when(F.col("metric") == "auprc", margin_auprc).otherwise(margin_auroc))
    whole = Window.partitionBy(F.lit(1))  # two rows
    loses, within = F.max((F.col("low") > F.col("margin")).cast("int")).over(whole), F.min((F.col("high") <= F.col("margin")).cast("int")).over(whole)
    verdict = F.when(loses == 1, "LOSES").when(within == 1, "NOT_WORSE").otherwise("UNDECIDED")
    return falls.select("metric", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), verdict.alias("verdict"))


def weighting_verdict(plain: DataFrame, weighted: DataFrame, margin: float = 0.1) -> DataFrame:
    """Relative gain in auprc of weighted training over paired draws: WEIGH if the whole interval lies above margin, else PLAIN."""
    gain = weighted.select("draw", F.col("auprc").alias("w")).join(plain.select("draw", F.col("auprc").alias("s")), "draw").select(((F.col("w") - F.col("s")) / F.nullif("s", F.lit(0.0))).alias("d"))
    q = gain.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg("d").alias("m"))
    return q.select(F.round("m", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"), F.when(F.col("q")[0] > margin, "WEIGH").otherwise("PLAIN").alias("verdict"))
