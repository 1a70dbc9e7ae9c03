import random
from collections import Counter

from cohortia.operators.rolling import rolling_totals, with_averages


def brute(events, windows, end):
    out, daily = {}, Counter()
    for k, d, m in events:
        if k is not None and d is not None and d <= end:
            daily[(k, d)] += m or 0
    there = {}
    for k, d in daily:
        there.setdefault(k, []).append(d)
    for k, days in there.items():
        for d in {x + i for x in days for i in range(max(windows)) if x + i <= end}:
            out[(k, d)] = tuple(sum(daily.get((k, d - j), 0) for j in range(n)) for n in windows)
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    events = [(rng.choice([1, 2, 3, None]), rng.choice([*range(0, 90), None]), rng.choice([1, 2, None])) for _ in range(120)]
    df = spark.createDataFrame([(*e, 0) for e in events], "k int, d int, m int, __last int")
    got = {(r["k"], r["d"]): (r["m_7"], r["m_30"]) for r in rolling_totals(df, "k", "d", ["m"], (7, 30), 80).collect()}
    assert got == brute(events, (7, 30), 80)
    floored = {(r["k"], r["d"]): (r["m_7"], r["m_30"]) for r in rolling_totals(df, "k", "d", ["m"], (7, 30), 80, floor=("m", 3)).collect()}
    assert floored == {k: v for k, v in got.items() if v[1] >= 3}


def test_fixed_denominator_and_empty(spark):
    df = spark.createDataFrame([(1, 10, 3), (1, 10, 4)], "k int, d int, m int")
    t = with_averages(rolling_totals(df, "k", "d", ["m"], (7,), 20), ["m"], (7,))
    assert {(r["d"], r["m_7"], r["m_7_media"]) for r in t.collect()} == {(d, 7, 1.0) for d in range(10, 17)}
    assert rolling_totals(df.limit(0), "k", "d", ["m"], (7,), 20).count() == 0
