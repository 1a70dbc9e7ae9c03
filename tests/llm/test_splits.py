import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortia.llm import splits


def union_find(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


GRAPHS = {
    "path": [(i, i + 1) for i in range(40)],
    "star": [(0, i) for i in range(1, 60)] + [(100, 101)],
    "random": [(random.Random(i).randrange(60), random.Random(i + 999).randrange(60)) for i in range(45)],
    "dirty": [(1, 2), (2, 1), (1, 2), (5, 5), (None, 7), (8, None), (9, 3)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    df = spark.createDataFrame([(*e, 0) for e in GRAPHS[name]], "a bigint, b bigint, nodo int")
    got = {r["nodo"]: r["grupo"] for r in splits.components(df, "a", "b").collect()}
    assert got == union_find(GRAPHS[name])


def test_components_empty_and_hot(spark):
    assert splits.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
    star = spark.range(1, 6000).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    assert splits.components(star, "a", "b").where("grupo <> 0").count() == 0


def test_torn_groups(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "nodo bigint, grupo bigint")
    rows = [(1, "A"), (2, "B"), (3, "A"), (4, None), (5, "A"), (5, "B"), (6, "A"), (6, "A"), (None, "A"), (None, "B")]
    df = spark.createDataFrame(rows, "p bigint, c string")
    assert sorted(r["p"] for r in splits.torn_groups(df, "p", "c", groups).collect()) == [1, 2, 5]


TARGETS = [("D", 0.7), ("V", 0.1), ("P", 0.2)]


@pytest.mark.parametrize("deal", [splits.assign_splits, splits.balanced_splits])
def test_shares_and_groups_whole(spark, deal):
    sizes = ([400, 150] if deal is splits.balanced_splits else []) + [1] * 20_000
    rows = [(g,) for g, n in enumerate(sizes) for _ in range(n)]
    out = deal(spark.createDataFrame([*rows, (None,)], "g bigint"), "g", TARGETS)
    got = out.collect()
    n = Counter(r["conjunto"] for r in got)
    assert n[None] == 1
    for s, w in TARGETS:
        assert abs(n[s] / len(rows) - w) < 0.01
    assert len({(r["g"], r["conjunto"]) for r in got}) == len(sizes) + 1
    again = deal(spark.createDataFrame([*reversed(rows)], "g bigint"), "g", TARGETS)
    assert {(r["g"], r["conjunto"]) for r in again.collect()} == {(r["g"], r["conjunto"]) for r in got if r["g"] is not None}


def test_a_large_group_moves_no_other(spark):
    alone = spark.range(20_000).withColumnRenamed("id", "g")
    joined = alone.unionByName(spark.range(3_000).select(F.lit(99_999).cast("bigint").alias("g")))
    a, b = ({r["g"]: r["conjunto"] for r in splits.assign_splits(x, "g", TARGETS).collect()} for x in (alone, joined))
    assert all(b[g] == s for g, s in a.items())


@pytest.mark.parametrize("deal", [splits.assign_splits, splits.balanced_splits])
def test_dominant_group_and_empty(spark, deal):
    out = deal(spark.createDataFrame([(1,)] * 90 + [(2,)] * 10, "g bigint"), "g", TARGETS)
    assert len({(r["g"], r["conjunto"]) for r in out.collect()}) == 2
    assert deal(spark.createDataFrame([], "g bigint"), "g", TARGETS).count() == 0


def test_rendezvous_is_consistent(spark):
    df = spark.range(3000)
    a = {r["id"]: r["s"] for r in df.select("id", splits.rendezvous("id", TARGETS).alias("s")).collect()}
    assert all(a[i] == splits._rendezvous_py(str(i), TARGETS) for i in range(200))
    more = {r["id"]: r["s"] for r in df.select("id", splits.rendezvous("id", [*TARGETS, ("X", 0.1)]).alias("s")).collect()}
    assert all(more[i] in (a[i], "X") for i in a)  # a new set only takes, nothing moves between old ones
