import random

import pytest

from cohortia.operators.intervals import merge_intervals, periods_and_gaps


def brute(rows):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        days, starts = set(), []
        for kk, a, b in rows:
            if kk == k and a is not None and b is not None and a <= b:
                days |= set(range(a, b + 1))
                starts.append(a)
        runs = []
        for d in sorted(days):
            if runs and runs[-1][1] == d - 1:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        if runs:
            out[k] = [(a, b, sum(a <= s <= b for s in starts)) for a, b in runs]
    return out


@pytest.mark.parametrize("shard", [5, 366])
def test_against_days(spark, shard):
    rng = random.Random(shard)
    rows = [(rng.choice([1, 2, None]), a, a + rng.choice([0, 1, 3, 40, -2])) for a in (rng.randrange(-60, 200) for _ in range(60))]
    rows += [(3, None, 4), (3, 4, None), (4, 7, 7), (4, 7, 7)] + [(5, 0, 400), (5, 10, 20)]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "k int, a int, b int, desde int, n int")
    got = {}
    for r in merge_intervals(df, "k", "a", "b", shard).orderBy("desde").collect():
        got.setdefault(r["k"], []).append((r["desde"], r["hasta"], r["n"]))
    assert got == brute(rows)


def test_gaps_adjacency_and_empty(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 8, 9)], "k int, a int, b int")
    got = sorted(tuple(r) for r in periods_and_gaps(merge_intervals(df, "k", "a", "b"), "k").collect())
    assert got == [(1, "HUECO", 6, 7, 0), (1, "PERIODO", 0, 5, 2), (1, "PERIODO", 8, 9, 1)]
    assert merge_intervals(df.limit(0), "k", "a", "b").count() == 0
