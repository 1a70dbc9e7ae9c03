from collections import Counter

from pyspark.sql import functions as F

from cohortia.operators import skew


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_heavy_keys_ties_nulls_and_clashing_columns(spark):
    data = [("a", 1, 0, 0)] * 2 + [("b", None, 0, 0)] * 1 + [(f"x{i}", 100 + i, 0, 0) for i in range(97)]
    df = spark.createDataFrame(data, "h string, p bigint, n int, clave int")  # 100 rows; columns named as the result's
    got = rows(skew.heavy_keys(df, {"h": F.col("h"), "p": F.col("p")}, per=50))
    assert got == [("h", "a", 2), ("p", "1", 2)]  # exactly 2 % counts, a missing key doesn't


def test_heavy_keys_empty(spark):
    df = spark.createDataFrame([], "h string")
    assert rows(skew.heavy_keys(df, {"h": F.col("h")})) == []


def test_key_totals_and_distinct(spark):
    data = [("a", 1, 1.0), ("a", 1, 2.0), ("a", None, None), (None, 2, 5.0)]
    df = spark.createDataFrame(data, "k string, v int, x double")
    assert rows(skew.key_totals(df.where("k is not null"), {"k": F.col("k")}, n=F.count(F.lit(1)), s=F.sum("x"))) == [("a", 3, 3.0)]
    got = {r["k"]: (r["n"], r["distintos"], r["s"]) for r in skew.distinct_per_key(df, ["k"], "v", s=F.col("x")).collect()}
    assert got == {"a": (3, 1, 3.0), None: (1, 1, 5.0)}


def test_hot_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(400)] + [(None, -1)], "k int, i int")
    right = spark.createDataFrame([(0, "zero"), (1, "one")], "k int, w string")
    plain = Counter(map(tuple, left.join(right, "k", "left").select("k", "i", "w").collect()))
    hot = skew.join_with_hot_keys(left, right, ["k"], [0])
    sized = skew.sized_join(left, right, ["k"], broadcast_rows=1)
    for df in (hot, sized):
        assert Counter(map(tuple, df.select("k", "i", "w").collect())) == plain
