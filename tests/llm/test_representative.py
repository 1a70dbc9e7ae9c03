import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortia.functions.text import read_plain
from cohortia.llm import representative as R

T0 = datetime(2024, 1, 1)
SCHEMA = "id bigint, k int, s string, d1 string, d2 string, d3 string, p1 string, p2 string, w string, peso double, t timestamp, n int, copies int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def run(df, **more):
    return R.representatives(df, "id", {"k": F.col("k"), "s": F.col("s")}, ("s",), {"dx": ["d1", "d2", "d3"], "px": ["p1", "p2"]}, {"alta": "w"}, "peso", "t", **more)


def row(i, k=1, s=None, d=(None,) * 3, p=(None,) * 2, w=None, peso=None, t=0):
    return (i, k, s, *d, *p, w, peso, None if t is None else T0 + timedelta(microseconds=t), 0, 0)


def brute(rows):
    groups = {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault((r[1], r[2]), []).append(r)
    filled = lambda xs: sum(read_plain(x) is not None for x in xs)
    rank = lambda r: (-filled(r[3:6]), -filled(r[6:8]), r[9] is None, -(r[9] or 0), r[10] is None, -(r[10] - T0).total_seconds() if r[10] else 0, r[0])
    return sorted(min(g, key=rank)[0] for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("block", [2, 512])
def test_survivor_against_definition(spark, block):
    rng = random.Random(block)
    code = lambda: rng.choice(["A1", "a1 ", "B2", "C3", "ignorado", "", None])
    rows = [row(i, rng.choice([1, 2, 3, 4, 5, None]), rng.choice(["M", None]), [code() for _ in range(3)], [code() for _ in range(2)], rng.choice(["DE ALTA", "ALTA", None]), rng.choice([None, 1.0, 2.5]), rng.choice([None, 0, 1, 2])) for i in range(90)]
    rows += [row(1000), row(1001, 77)]
    got = run(frame(spark, rows), block=block)
    assert sorted(r["id"] for r in got.collect()) == brute(rows)


def test_built_values(spark):
    rows = [
        row(1, d=("A1", None, "C3"), p=("X", None), w="DERIVACIÓN OTRO HOSPITAL", t=5),
        row(2, d=("A1", "B2", None), p=(None, None), w="DERIVACION HOSPITAL", t=9),
        row(3, d=("A1", "B2", "C3"), p=(None, None), w="DERIVACIÓN OTRO HOSPITAL"),
    ]
    r = run(frame(spark, rows)).first()
    assert (r["n"], r["id"], r["dx"], r["px"]) == (3, 3, ["A1", "B2", "C3"], ["X"])  # px comes from another record
    assert r["alta"] == ["DERIVACIÓN", "OTRO", "HOSPITAL"]


def test_exact_copies_ties_and_empty(spark):
    same = [row(i, d=("A1", None, None), peso=1.0) for i in (9, 4, 7)]
    r = run(frame(spark, same)).first()
    assert (r["n"], r["id"], r["px"]) == (3, 4, None)
    assert run(frame(spark, [])).count() == 0 and run(frame(spark, [row(1), row(2, k=None), row(3, k=None)])).count() == 0


def test_many_blocks_merge_to_the_same(spark):
    rng = random.Random(4)
    rows = [row(i, d=tuple(rng.choice(["A", "B", "C", None]) for _ in range(3)), peso=float(i % 13), t=i) for i in range(300)]
    a, b = (run(frame(spark, rows), block=k).first() for k in (3, 1000))
    assert (a["n"], a["id"]) == (b["n"], b["id"]) == (300, brute(rows)[0])


def test_alignment():
    p = lambda *ts: [{t: 1.0} for t in ts]
    assert R.align(p("a", "b", "c"), p("a", "c")) == [(0, 0), (1, -1), (2, 1)]
    assert R.align([], p("a")) == [(-1, 0)]
    profile = R.merge_profiles(R.merge_profiles(p("a", "b"), p("a", "x")), p("a", "x"))
    assert R.consensus(profile, 3.0) == ["a", "x"]
    assert R.distance(("a", "c"), ["a", "b", "c"]) == R.distance(("a", "z"), ["a", "b"]) == 1
    assert R.seat(("a",), profile) == (1, 0) and R.seat(("a", "b"), profile) == (0, 1) and R.seat((), profile) == (2, 0)
    with pytest.raises(ValueError):
        R.seat(("a", "b", "c"), profile)


def test_gaps_vote_against_an_outlier(spark):
    rows = [row(i, d=("A", "B", "C"), t=i) for i in range(9)] + [row(20, d=("X", "Y", "Z"), p=("W", "W"), t=50)]
    outlier = R.new_state(["f"])
    for _ in range(9):
        R.add_record(outlier, {"f": ("A", "B", "C")}, 1)
    R.add_record(outlier, {"f": ("X", "Y", "Z", "W")}, 1)
    assert R.closest_values(outlier) == {"f": ["A", "B", "C"]}
    assert run(frame(spark, rows)).first()["dx"] == ["A", "B", "C"]


def test_the_alignment_decides(monkeypatch):
    """Without the profile no record can be laid on it: the choice hangs on the alignment."""
    monkeypatch.setattr(R, "merge_profiles", lambda a, b: [])
    state = R.new_state(["f"])
    R.add_record(state, {"f": ("A", "B")}, 1)
    with pytest.raises(ValueError):
        R.choose(state, [[[("A", "B")], [0, 0.0, 0, 1]]])


def test_beyond_the_broadcast_bound(spark):
    rng = random.Random(8)
    rows = [row(i, rng.randrange(40), d=tuple(rng.choice(["A", "B", None]) for _ in range(3)), peso=float(i % 7), t=i) for i in range(200)]
    near, far = (sorted(tuple(map(str, r)) for r in run(frame(spark, rows), broadcast_groups=k).collect()) for k in (1000, 0))
    assert near == far and len(near) > 30
    bare = run(frame(spark, rows), build=False).collect()
    assert sorted(r["id"] for r in bare) == brute(rows) and all(r["dx"] is None for r in bare)


def chosen(records, fields=1):
    """Id of the record that stays of [tokens of each field, trust]."""
    state = R.new_state([f"f{i}" for i in range(fields)])
    for tokens, _ in records:
        R.add_record(state, {f"f{i}": t for i, t in enumerate(tokens)}, 1)
    R.choose(state, [[tokens, [0, -trust, 0, i]] for i, (tokens, trust) in enumerate(records)])
    return state["best"][-1][-1]


def test_vote_and_distance_choose_the_record_that_stays(monkeypatch):
    few = [[("A", "B")], 1.0]
    assert chosen([few, few, few, [[("X", "Y", "Z")], 0.0]]) == 3  # outvotes all that fill less
    assert chosen([[[("A", "B")], 1.0], [[("A", "C")], 2.0], [[("A", "B")], 1.5]]) == 1
    assert chosen([[[("A",), ("P",)], 1.0], [[("B",), ("P", "Q")], 0.0]], 2) == 1
    with monkeypatch.context() as m:
        m.setattr(R, "consensus", lambda profile, total: ["A", "B"])
        assert chosen([[[("X", "Y", "Z")], 0.0], few]) == 1
    monkeypatch.setattr(R, "distance", lambda tokens, agreed: len(tokens))
    assert chosen([[[("X", "Y", "Z")], 0.0], few]) == 1


def test_consensus_of_the_ranked_vote_is_the_definitions_record():
    rng = random.Random(3)
    for _ in range(300):
        records = [[[tuple(rng.choice("ABC") for _ in range(rng.randrange(5))) for _ in range(2)], float(rng.randrange(3))] for _ in range(rng.randrange(2, 7))]
        wanted = min(range(len(records)), key=lambda i: ([-len(t) for t in records[i][0]], -records[i][1], i))
        assert chosen(records, 2) == wanted
